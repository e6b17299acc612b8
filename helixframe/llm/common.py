"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a function of map_arrow gets at most.
BATCH_ROWS = 2000
#: Bytes of an Arrow batch that goes to a Python worker: a bound whatever the texts' length (one row may exceed it).
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes an Arrow batch carries to a Python worker.

    Spark reads the setting when a plan runs, after the operator has returned, so it stays in the session; it is only
    ever lowered, and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where the session has none (tests on one machine), a folder under the warehouse is set as checkpoint dir.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        base = f"{warehouse.rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch (of BATCH_ROWS rows at most) to a dict of columns."""
    spark = df.sparkSession
    small_batches(spark)
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                out = function(whole.slice(at, BATCH_ROWS))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in wanted], schema=wanted)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if not isinstance(schema, T.StructType) else schema)


def local_path(path: str) -> str | None:
    """The plain path of a file: URI or of a path without a scheme; else None."""
    if path.startswith("file:"):
        rest = path[5:]
        return "/" + rest.lstrip("/") if rest.startswith("//") or rest.startswith("/") else rest
    return None if "://" in path else path


def open_fs(path: str):
    """(pyarrow filesystem, path inside it) of a shared path."""
    from pyarrow import fs

    plain = local_path(path)
    if plain is not None:
        return fs.LocalFileSystem(), os.path.abspath(plain)
    return fs.FileSystem.from_uri(path)


def write_bytes(path: str, data: bytes) -> None:
    """Write one file so that a retried or doubled task leaves a whole file: temporary name, then rename."""
    fs_, inner = open_fs(path)
    fs_.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{os.path.dirname(inner)}/.{os.path.basename(inner)}.{uuid.uuid4().hex}"
    with fs_.open_output_stream(part) as out:
        out.write(data)
    fs_.move(part, inner)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
