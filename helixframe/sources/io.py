"""Reading and writing: formats by name, by content or by extension.

Records that a separator ends (FASTA, GenBank, EMBL, Stockholm) are split by Spark's text source, so one large file is
read by many tasks. Formats whose lines depend on earlier ones (GFF, tables, tabular hits, MEME) are read line by line in
one task a file, which holds a few thousand features at a time; Clustal and lossless JSON are read as whole texts.
Parsers run in Arrow batches. `ord` numbers records by file, place in it and, in features, place in the record.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import os
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import sequence_type
from . import parsers

#: Rows, and letters of sequences, that a task holds before it gives them on.
ROWS, LETTERS = 4096, 1 << 22
LOC = "struct<start:bigint,stop:bigint,strand:string,defect:int,meta_json:string>"
SEQS = "id string, data string, header string, meta_json string, src_file string, block long, row long"
FTS = f"seqid string, type string, name string, id string, score double, evalue double, start bigint, stop bigint, strand string, defect int, locs array<{LOC}>, meta_json string, src_file string, block long, row long"


class Format(NamedTuple):
    """How a format is read. parse gives sequences or features of one record (or file); separator splits records.

    by_line: the parsers take the lines of a file as they come.
    """

    name: str
    extensions: tuple[str, ...]
    sniff: Callable[[str], bool]
    parse: Callable[..., Iterator[dict]] | None = None
    parse_fts: Callable[..., Iterator[dict]] | None = None
    separator: str | None = None
    by_line: bool = False


def _features_of(parse):
    return lambda text, **options: (f for record in parse(text, **options) for f in record["features"])


def _gff_seqs(text: str | Iterable[str], **options) -> Iterator[dict]:
    """Sequences behind ##FASTA; the file's features are read_fts()'s, and attach() brings both together."""
    lines = iter(parsers.lines_of(text))
    for line in lines:
        _, found, rest = line.partition("##FASTA")
        if found:
            yield from parsers.parse_fasta(itertools.chain((rest,), lines))


def _is_gtf(head: str) -> bool:
    line = next((x for x in head.splitlines() if x.strip() and not x.startswith("#")), "")
    f = line.split("\t")
    return not head.startswith("##gff") and len(f) > 7 and f[3].isdigit() and f[4].isdigit() and f[6] in "+-.?" and f[7] in "012."


def _hit_share(head: str, columns: tuple[str, ...], key: str, most: float) -> bool:
    line = next((x for x in head.splitlines() if x.strip() and not x.startswith("#")), "")
    f = line.split("\t" if "\t" in line else "," if "," in line else None)
    try:
        return len(f) >= len(columns) and 0 <= float(f[columns.index(key)]) <= most and float(f[6]) >= 1
    except ValueError:
        return False


def _is_table(head: str, sep: str) -> bool:
    lines = [x.split(sep) for x in head.splitlines()[:-1] or head.splitlines() if x]
    return bool(lines) and len({"start", "stop", "len"} & set(lines[0])) >= 2 and len({len(x) for x in lines}) == 1


#: Columns of a table that aren't metadata.
_OWN = {"type", "start", "stop", "strand", "len", "seqid", "name", "score"}


def parse_table(text: str | Iterable[str], sep: str = "\t", ftype: str | None = None, one_based: bool = False) -> Iterator[dict]:
    """Features of a table with a header line; start, stop and len complete each other."""
    rows = csv.reader((x + "\n" for x in parsers.lines_of(text)), delimiter=sep)
    names = next(rows, [])
    for fields in filter(None, rows):
        row = dict(zip(names, fields, strict=False))
        if len(fields) > len(names):
            row[None] = fields[len(names) :]
        start = int(row["start"]) - one_based if row.get("start") else int(row["stop"]) - int(row["len"])
        stop = int(row["stop"]) if row.get("stop") else start + int(row["len"])
        meta = {k: v for k, v in row.items() if k not in _OWN and v != ""}
        type_ = row.get("type") or (row.get(ftype, ftype) if ftype else None)
        yield parsers.feature(row.get("seqid"), type_, [parsers.place(start, stop, row.get("strand") or "?")], meta, name=row.get("name"), score=float(row["score"]) if row.get("score") else None)


SJSON_BANNER = "sequence table json"


def parse_sjson(text: str) -> Iterator[dict]:
    for row in json.loads(text).get("seqs", []):
        yield {"id": row["id"], "data": row["data"], "header": row.get("header"), "meta": row.get("meta") or {}, "features": row.get("features") or []}


def parse_sjson_fts(text: str) -> Iterator[dict]:
    content = json.loads(text)
    yield from content.get("fts", [])
    for row in content.get("seqs", []):
        yield from row.get("features") or []


FORMATS: dict[str, Format] = {}


def register(fmt: Format) -> None:
    """Add a format; those added later are tried later by detect()."""
    FORMATS[fmt.name] = fmt


for _f in (
    Format("fasta", ("fasta", "fa", "fna", "faa", "fas"), lambda h: h[:50].lstrip().startswith(">"), parsers.parse_fasta, None, "\n>"),
    Format("genbank", ("gb", "gbk", "genbank"), lambda h: h[:5].lower() == "locus", parsers.parse_genbank, _features_of(parsers.parse_genbank), "\n//"),
    Format("embl", ("embl",), lambda h: h.startswith("ID   "), parsers.parse_embl, _features_of(parsers.parse_embl), "\n//"),
    Format("clustal", ("clustal", "aln"), lambda h: h.startswith("CLUSTAL"), parsers.parse_clustal),
    Format("stockholm", ("stk", "sto", "stockholm"), lambda h: h.startswith("# STOCKHOLM"), parsers.parse_stockholm, None, "\n//"),
    Format("gff", ("gff", "gff3"), lambda h: h[:100].startswith("##gff-version"), _gff_seqs, parsers.parse_gff, None, True),
    Format("gtf", ("gtf",), _is_gtf, None, lambda text, **o: parsers.parse_gff(text, gtf=True, **o), None, True),
    Format("infernal", (), lambda h: "target name" in h[:400] and "mdl from" in h[:400] and h.startswith("#"), None, parsers.parse_infernal, None, True),
    Format("mmseqs", (), lambda h: len(first := h.split("\n", 1)[0].split()) > 1 and set(first) <= set(parsers.MMSEQS_NAMES) or _hit_share(h, parsers.MMSEQS_COLUMNS, "fident", 1), None, parsers.parse_mmseqs, None, True),
    Format("meme_txt", (), lambda h: h.startswith("*") and h.split("\n")[1:2] != [] and h.split("\n")[1].startswith("MEME"), None, parsers.parse_meme, None, True),
    Format("blast", ("blastn", "blastp"), lambda h: h.startswith("#") and "BLAST" in h or _hit_share(h, parsers.HIT_COLUMNS, "pident", 100), None, parsers.parse_blast, None, True),
    Format("tsv", ("tsv",), lambda h: _is_table(h, "\t"), None, parse_table, None, True),
    Format("csv", ("csv",), lambda h: _is_table(h, ","), None, lambda text, **o: parse_table(text, **({"sep": ","} | o)), None, True),
    Format("sjson", ("sjson", "json"), lambda h: SJSON_BANNER in h[:60], parse_sjson, parse_sjson_fts),
):
    register(_f)


def sniff_text(head: str, what: str = "seqs") -> str | None:
    for fmt in FORMATS.values():
        if fmt.parse if what == "seqs" else fmt.parse_fts:
            try:
                if fmt.sniff(head):
                    return fmt.name
            except Exception:  # a sniffer that fails says no
                continue
    return None


def detect_ext(path: str, what: str = "seqs") -> str | None:
    extension = path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path) else ""
    return next((f.name for f in FORMATS.values() if extension in f.extensions and (f.parse if what == "seqs" else f.parse_fts)), None)


def _is_archive(path: str) -> bool:
    return path.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz"))


def members(name: str, content: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of the files in a zip or tar archive, sorted by name."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n in sorted(z.namelist()):
                if not n.endswith("/"):
                    yield n, z.read(n).decode("latin1")
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in sorted((m for m in t.getmembers() if m.isfile()), key=lambda m: m.name):
                yield m.name, t.extractfile(m).read().decode("latin1")


def detect(spark: SparkSession, path: str, what: str = "seqs") -> str | None:
    """The format of the first file that a path means, by its first lines."""
    if _is_archive(path):
        row = spark.read.format("binaryFile").load(path).select("path", "content").first()
        head = next(members(row["path"], bytes(row["content"])))[1][:4000] if row else ""
    else:
        head = "\n".join(r[0] for r in spark.read.text(path).limit(40).collect())
    if not head.strip():
        raise OSError(f"{path} is empty")
    return sniff_text(head, what)


def _texts(spark: SparkSession, path: str, own: Format) -> tuple[DataFrame, bool]:
    """(src_file, block, text), and whether they are lines: one row for each record, line or file, in order within a block."""
    if _is_archive(path):
        def unpack(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, (member, text) in enumerate(members(name, content)):
                        yield pa.RecordBatch.from_pydict({"src_file": [f"{name}!{member}"], "block": [k], "text": [text]})

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "src_file string, block long, text string"), False
    if own.separator is None and not own.by_line:
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("src_file"), F.lit(0).cast("long").alias("block"), F.col("value").alias("text")), False
    lines = spark.read.text(path, lineSep=own.separator or "\n")
    named = lines.select(F.input_file_name().alias("src_file"), F.input_file_block_start().alias("block"), F.col("value").alias("text"))
    if own.by_line:
        if named.agg(F.max("block")).first()[0]:  # a file that several tasks read comes back to one, in order
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            named = named.withColumn("at", F.monotonically_increasing_id()).repartition(parts, "src_file").sortWithinPartitions("src_file", "block", "at")
        return named.select("src_file", F.lit(0).cast("long").alias("block"), "text"), True
    # the separator's second half belongs to the next record, and goes from all but the first
    begin = own.separator.lstrip("\n")
    text = F.when(F.startswith("text", F.lit(begin)) if begin == ">" else F.lit(True), F.col("text")).otherwise(F.concat(F.lit(begin), "text"))
    return named.withColumn("text", text).filter(F.col("text").rlike(r"[^\s/]")), False


def _runs(batches: Iterator) -> Iterator[tuple[tuple[str, int], object]]:
    """((src_file, block), texts) of neighbouring rows of one block, in order."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column(0).dictionary_encode()
        block = batch.column(1).to_numpy(zero_copy_only=False)
        number = files.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((number[1:] != number[:-1]) | (block[1:] != block[:-1])) + 1
        for low, high in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield (files.dictionary[int(number[low])].as_py(), int(block[low])), batch.column(2).slice(low, high - low)


#: As json.dumps(sort_keys=True).
_dumped = json.JSONEncoder(sort_keys=True).encode


def _seqs_columns(rows: list[dict]) -> list[list]:
    return [[r["id"] for r in rows], [r["data"] for r in rows], [r["header"] for r in rows], [_dumped(r["meta"]) for r in rows]]


def _fts_columns(rows: list[dict], locs_type) -> list:
    import pyarrow as pa

    every = [x for r in rows for x in r["locs"]]
    ends = list(itertools.accumulate((len(r["locs"]) for r in rows), initial=0))
    own = [[x[k] for x in every] for k in ("start", "stop", "strand")] + [[x.get("defect", 0) for x in every], [_dumped(x["meta"]) if x.get("meta") else None for x in every]]
    struct = locs_type.value_type
    locs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(own, struct, strict=True)], fields=list(struct)), type=locs_type)
    start, stop = own[0], own[1]
    if len(every) > len(rows):
        start, stop = ([f(v[a:b]) for a, b in itertools.pairwise(ends)] for f, v in ((min, start), (max, stop)))
    first = ends[:-1]
    names = [[r.get(k) for r in rows] for k in ("seqid", "type", "name", "id", "score", "evalue")]
    return [*names, start, stop, [own[2][k] for k in first], [own[3][k] for k in first], locs, [_dumped(r["meta"]) for r in rows]]


def parsed_batches(batches: Iterator, parse, what: str, options: dict, by_line: bool, wanted) -> Iterator:
    """Arrow batches of what parse finds in those of (src_file, block, text), of at most ROWS rows or about LETTERS letters.

    A batch goes on over records, so many small ones take few batches. by_line: the texts of a block are a file's
    lines, else each is parsed by itself.
    """
    import pyarrow as pa

    def found(blocks: Iterator) -> Iterator[dict]:
        texts = (x for _, column in blocks for at in range(0, len(column), ROWS) for x in column.slice(at, ROWS).to_pylist())
        if by_line:
            yield from parse(itertools.dropwhile(lambda x: not x, texts), **options)
        else:
            for text in texts:
                yield from parse(text.lstrip("\n"), **options)

    def cut(rows: Iterator[dict]) -> Iterator[list[dict]]:
        part, letters = [], 0
        for r in rows:
            part.append(r)
            letters += len(r["data"]) if what == "seqs" else len(r["locs"])
            if len(part) >= ROWS or letters >= LETTERS:
                yield part
                part, letters = [], 0
        if part:
            yield part

    for (src, block), blocks in itertools.groupby(_runs(batches), key=lambda x: x[0]):
        at = 0
        for rows in cut(found(blocks)):
            n = len(rows)
            columns = _seqs_columns(rows) if what == "seqs" else _fts_columns(rows, wanted.field("locs").type)
            columns += [[src] * n, [block] * n, range(at, at + n)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)
            at += n


def _parsed(texts: DataFrame, parse, what: str, options: dict, by_line: bool = False) -> DataFrame:
    """Sequences or features of (src_file, block, text), with the number of their row within their block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = SEQS if what == "seqs" else FTS
    wanted = to_arrow_schema(T._parse_datatype_string(schema))
    return texts.mapInArrow(lambda batches: parsed_batches(batches, parse, what, options, by_line, wanted), schema)


def _placed(parsed: DataFrame) -> DataFrame:
    """`place`, a text that orders the rows of a file, for block and row."""
    return parsed.withColumn("place", F.format_string("%015d-%012d", "block", "row")).drop("block", "row")


def _numbered(parsed: DataFrame) -> DataFrame:
    """ord as 0, 1, ... by file, block and row.

    Rows are numbered within their block, and shifted by the sizes of the blocks before: no row is shuffled or sorted.
    """
    kept = parsed.persist(StorageLevel.DISK_ONLY)  # both uses below see one parsing
    sizes = kept.groupBy("src_file", "block").agg((F.max("row") + 1).alias("_n"))
    before = Window.orderBy("src_file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("src_file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a block
    names = [c for c in parsed.columns if c not in ("block", "row")]
    return kept.join(F.broadcast(shifts), ["src_file", "block"]).select((F.col("_before") + F.col("row")).alias("ord"), *names)


def _finished(parsed: DataFrame, fmt: str, what: str, numbered: bool = True) -> DataFrame:
    named = (_numbered(parsed) if numbered else _placed(parsed)).withColumn("fmt", F.lit(fmt))
    return named.withColumn("type", sequence_type("data")) if what == "seqs" else named


def _read(spark: SparkSession, path: str, fmt: str | None, what: str, options: dict, numbered: bool) -> DataFrame:
    name = fmt or detect(spark, path, what)
    if name is None:
        raise OSError(f"the format of {path} can't be detected")
    own = FORMATS[name]
    parse = own.parse if what == "seqs" else own.parse_fts
    if parse is None:
        raise ValueError(f"{name} has no {what}")
    texts, by_line = _texts(spark, path, own)
    return _finished(_parsed(texts, parse, what, options, by_line), name, what, numbered)


def read(spark: SparkSession, path: str, fmt: str | None = None, numbered: bool = True, **options) -> DataFrame:
    """Sequences of a file, folder, glob, gz or archive.

    Numbers (ord) keep the parsed rows on disk; numbered=False leaves the order in src_file and place, and reading is
    narrow.
    """
    return _read(spark, path, fmt, "seqs", options, numbered)


def read_fts(spark: SparkSession, path: str, fmt: str | None = None, numbered: bool = True, **options) -> DataFrame:
    """Features of a file, folder, glob, gz or archive; numbered as in read()."""
    return _read(spark, path, fmt, "fts", options, numbered)


def iterate(spark: SparkSession, path: str, fmt: str | None = None, what: str = "seqs", **options) -> Iterator:
    """The rows of read() or read_fts() one by one, in order; the driver holds one part at a time."""
    found = (read if what == "seqs" else read_fts)(spark, path, fmt, **options)
    yield from found.orderBy("ord").toLocalIterator()


def from_string(spark: SparkSession, text: str, fmt: str | None = None, what: str = "seqs", **options) -> DataFrame:
    """Sequences or features of a text at hand."""
    if not text.strip():
        raise OSError("the text is empty")
    name = fmt or sniff_text(text[:4000], what)
    if name is None:
        raise OSError("the text's format can't be detected")
    parse = FORMATS[name].parse if what == "seqs" else FORMATS[name].parse_fts
    texts = spark.createDataFrame([("", 0, text)], "src_file string, block long, text string")
    return _finished(_parsed(texts, parse, what, options), name, what)
