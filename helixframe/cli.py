"""Command line: print, cat, catf, merge, rc, translate and index.

python -m helixframe.cli cat IN... -o OUT -fo fasta
"""

from __future__ import annotations

import argparse
import functools
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequence import reverse_complement
from .operators import counting, joins, rows
from .operators.translate import translate, translate_text
from .sources import fastaindex, io, writers


def _joined(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(rows.list_add, tables)


def _put(df: DataFrame, args) -> None:
    if args.out:
        writers.write(df, args.out, args.fmtout, single=True)
    else:
        sys.stdout.write(writers.to_string(df, args.fmtout or ("fasta" if "data" in df.columns else "gff")))


def summary(df: DataFrame, n: int = 10) -> str:
    """A few lines about sequences or features, with their number."""
    total = df.count()
    if "data" in df.columns:
        shown = df.orderBy("ord").select("id", F.length("data").alias("len"), F.substring("data", 1, 40).alias("data")).limit(n).collect()
        lines = [f"{r['id'] or '':15} {r['len']:>10} {r['data']}" for r in shown]
        return "\n".join([f"{total} sequences", *lines])
    shown = df.orderBy("ord").limit(n).collect()
    return "\n".join([f"{total} features", *(f"{r['type'] or '':12} {r['strand']} {r['stop'] - r['start']:>10} {r['start']:>10}-{r['stop']:<10} {r['seqid'] or ''}" for r in shown)])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("print", "printf", "cat", "catf", "merge", "rc", "translate"):
        p = sub.add_parser(name)
        p.add_argument("files", nargs="+")
        p.add_argument("-f", "--fmt")
        p.add_argument("-o", "--out")
        p.add_argument("-fo", "--fmtout")
        if name == "translate":
            p.add_argument("--cds", action="store_true")
            p.add_argument("-c", "--complete", action="store_true")
            p.add_argument("-tt", type=int, default=1)
    p = sub.add_parser("index")
    p.add_argument("action", choices=("create", "info", "fetch"))
    p.add_argument("index")
    p.add_argument("what", nargs="*")
    return top


def run(spark: SparkSession, argv: list[str]) -> None:
    args = parser().parse_args(argv)
    if args.command == "index":
        if args.action == "create":
            tables = [fastaindex.build_index(spark, f) for f in args.what]
            fastaindex.save_index(functools.reduce(DataFrame.unionByName, tables), args.index)
        elif args.action == "info":
            print(fastaindex.index_info(spark.read.parquet(args.index)).first().asDict())
        else:
            found = fastaindex.fetch(spark.read.parquet(args.index), [fastaindex.parse_request(w) for w in args.what])
            sys.stdout.write(writers.to_string(found, "fasta"))
        return
    literal = args.command in ("rc", "translate") and len(args.files) == 1 and not os.path.exists(args.files[0]) and args.files[0].isalpha()
    if literal:
        text = args.files[0].upper()
        if args.command == "rc":
            print(spark.createDataFrame([(text,)], "data string").select(reverse_complement("data")).first()[0])
        else:
            print(translate_text(text, complete=args.complete, tt=args.tt))
        return
    if args.command in ("printf", "catf"):
        found = _joined([io.read_fts(spark, f, args.fmt) for f in args.files])
    else:
        found = _joined([io.read(spark, f, args.fmt) for f in args.files])
    if args.command in ("print", "printf"):
        print(summary(found))
        return
    if args.command == "merge":
        found = counting.merge(found)
    elif args.command == "rc":
        found = found.withColumn("data", reverse_complement("data"))
    elif args.command == "translate":
        if args.cds:
            features = _joined([io.read_fts(spark, f, args.fmt) for f in args.files])
            found = joins.extract_type(found, features, "cds")
        found = translate(found, complete=args.complete, tt=args.tt)
    _put(found, args)


def main() -> None:
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()
