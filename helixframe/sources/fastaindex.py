"""Random access to FASTA files by id and range.

The index is a table (seqid, file, linelen, offset, size): the byte where a record's data begins, the length of its
lines (0: one line) and its data's bytes. Building it is one pass over the files, in blocks; lookups join the requests
with the index and read byte ranges.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "seqid string, file string, linelen int, eol int, offset long, size long"


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Index of all records in the files. Offsets add up record sizes within blocks, and blocks within files."""
    lines = spark.read.text(path, lineSep="\n>")
    block = F.input_file_block_start()
    row = lines.select(F.input_file_name().alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row"), "value").withColumn("bytes", F.octet_length("value").cast("long") + 2)
    slim = row.select("file", "block", "row", "bytes", F.split("value", "\n", 3).alias("head"), F.octet_length("value").alias("len"), F.startswith("value", F.lit(">")).alias("first"))
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    blocks = slim.groupBy("file", "block").agg(F.sum("bytes").alias("all"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("from"))
    placed = slim.withColumn("in", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(starts, ["file", "block"])
    header = F.element_at("head", 1)
    seqid = F.regexp_extract(header, r"^>?\s*(\S*)", 1)
    crlf = F.endswith(header, F.lit("\r"))
    eol = F.when(crlf, 2).otherwise(1)
    line = F.try_element_at("head", F.lit(2))
    one = F.try_element_at("head", F.lit(3)).isNull() | (F.trim(F.try_element_at("head", F.lit(3))) == "")
    size = F.col("len") - F.octet_length(header) - 1
    return placed.filter(F.trim(header) != "").select(seqid.alias("seqid"), "file", F.when(one, 0).otherwise(F.octet_length(F.rtrim(line, F.lit("\r")))).cast("int").alias("linelen"), eol.cast("int").alias("eol"), (F.col("from") + F.col("in") + F.octet_length(header) + 1).alias("offset"), F.greatest(size, F.lit(0)).cast("long").alias("size"))


def add_files(index: DataFrame, path: str) -> DataFrame:
    """The index with all records in the files at path; what it had of these files is made anew."""
    new = build_index(index.sparkSession, path)
    return index.join(new.select("file").distinct(), "file", "left_anti").select(*index.columns).unionByName(new.select(*index.columns))


def fetch_fasta(index: DataFrame, requests: Sequence[str | tuple]) -> DataFrame:
    """(ord, fasta): the requested records as FASTA text, headed by id, or by id and range."""
    asked = [(k, *((r, None, None) if isinstance(r, str) else r)) for k, r in enumerate(requests)]
    names = [(k, i if start is None and stop is None else f"{i}:{start or 0}-{'' if stop is None else stop}") for k, i, start, stop in asked]
    heads = index.sparkSession.createDataFrame(names, "ord long, head string")
    return fetch(index, requests).join(F.broadcast(heads), "ord").select("ord", F.concat(F.lit(">"), "head", F.lit("\n"), "data").alias("fasta"))


def save_index(index: DataFrame, path: str) -> None:
    """Sorted by id, so that min/max of row groups prune lookups."""
    index.repartitionByRange("seqid").sortWithinPartitions("seqid").write.mode("overwrite").parquet(path)


def parse_request(text: str) -> tuple[str, int | None, int | None]:
    """id or id,start,stop; 0 or - as stop is an open end."""
    parts = text.strip().split(",")
    if len(parts) == 1:
        return parts[0], None, None
    start, stop = (int(x) if x not in ("", "-") else 0 for x in parts[1:3])
    return parts[0], start, stop or None


def fetch(index: DataFrame, requests: Sequence[str | tuple]) -> DataFrame:
    """(ord, id, data) in the order of the requests: ids, or (id, start, stop) with None for an open end.

    requests are a list at hand, so their table is small; an id that the index lacks fails.
    """
    spark = index.sparkSession
    wanted = [(k, *((r, None, None) if isinstance(r, str) else r)) for k, r in enumerate(requests)]
    for _, name, start, stop in wanted:
        if stop is not None and stop < 0:
            raise ValueError(f"negative stop for {name}")
        if start is not None and start < 0:
            warnings.warn(f"negative start for {name} is taken as 0", stacklevel=2)
    asked = spark.createDataFrame(wanted, "ord long, id string, start long, stop long")
    ids = sorted({w[1] for w in wanted})
    pruned = index.filter(F.col("seqid").isin(*ids)) if len(ids) <= 1000 else index  # row groups are skipped by it
    placed = F.broadcast(asked).join(pruned, F.col("id") == F.col("seqid"))
    missing = asked.select("id").distinct().join(placed.select("id").distinct(), "id", "left_anti").orderBy("id").limit(10).collect()
    if missing:
        raise KeyError(f"not in the index: {', '.join(str(r['id']) for r in missing)}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from urllib.parse import unquote

        for batch in batches:
            out = []
            for number, name, start, stop, file, linelen, eol, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plain = unquote(file)
                where, inner = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain.removeprefix("file:"))
                low = max(start or 0, 0)
                at = lambda i: i + i // linelen * eol if linelen else i  # noqa: E731, B023
                begin = min(at(low), size)
                end = size if stop is None else min(at(max(stop, low)), size)
                with where.open_input_file(inner) as source:
                    data = source.read_at(end - begin, offset + begin)
                text = data.translate(None, b"\r\n \t").decode("latin1").upper()
                out.append((number, name, text if stop is None else text[: stop - low]))
            yield pa.RecordBatch.from_pydict(dict(zip(("ord", "id", "data"), zip(*out, strict=True), strict=True)) if out else {"ord": pa.array([], pa.int64()), "id": pa.array([], pa.string()), "data": pa.array([], pa.string())})

    columns = ["ord", "id", "start", "stop", "file", "linelen", "eol", "offset", "size"]
    return placed.select(*columns).mapInArrow(run, "ord long, id string, data string").orderBy("ord")


def index_info(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.sum("size").alias("totalsize"))
