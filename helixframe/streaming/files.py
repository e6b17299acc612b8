"""Sequences and features from files as they arrive: stateless, one micro-batch for new files.

The same parsers as in batch reading run on each file; a file's records keep their place in it. There is no event
time and no state, as records don't depend on each other across files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import sequence_type
from ..sources import io


def stream(spark: SparkSession, folder: str, fmt: str, what: str = "seqs", **options) -> DataFrame:
    """A streaming table of the records of files in folder. fmt is given, as a stream has no first file to look at.

    `place` orders the records of a file; there is no `ord` over all files of a stream.
    """
    own = io.FORMATS[fmt]
    parse = own.parse if what == "seqs" else own.parse_fts
    if parse is None:
        raise ValueError(f"{fmt} has no {what}")
    texts = spark.readStream.option("wholetext", "true").schema("value string").format("text").load(folder)
    named = texts.select(F.input_file_name().alias("src_file"), F.lit(0).cast("long").alias("block"), F.col("value").alias("text"))
    found = io._placed(io._parsed(named, parse, what, options)).withColumn("fmt", F.lit(fmt))
    return found.withColumn("type", sequence_type("data")) if what == "seqs" else found
