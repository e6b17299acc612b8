"""Sequences, features and metadata derived from the driver tables, with the same rules in SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.locations import location

LETTERS = string.ascii_uppercase + string.ascii_lowercase
BASES = ("ACGT" * 7)[:26] * 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: letters alone, each mapped to a base."""
    docs = table(spark, sf_dir, "documents")
    data = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, BASES)
    return docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), data.alias("data"))


def fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a part is a sequence, shipping day and quantity give the range, the line number's parity the strand."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    start = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    out = rows.select(
        (F.col("l_partkey") * 100_000 + F.row_number().over(order)).alias("ord"),
        F.col("l_partkey").cast("string").alias("seqid"),
        F.concat("l_returnflag", "l_linestatus").alias("type"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("stop"),
        F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+").alias("strand"),
    )
    return out


def with_locs(features: DataFrame) -> DataFrame:
    return features.withColumn("locs", F.array(location(F.col("start"), F.col("stop"), F.col("strand"))))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("data"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: turns as sequences that share their conversation's id."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("turn").alias("ord"), F.col("conv_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("data"))


SEQS = f"seqs as (select doc_id as ord, cast(doc_id as varchar) as id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}') as data from documents)"
FTS = """fts0 as (
    select l_partkey * 100000 + row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as ord,
        cast(l_partkey as varchar) as seqid, l_returnflag || l_linestatus as type,
        date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as start,
        cast(l_quantity as bigint) as quantity, case when l_linenumber % 2 = 0 then '-' else '+' end as strand
    from lineitem),
fts as (select ord, seqid, type, start, start + quantity as stop, strand from fts0)"""
PROTEINS = "proteins as (select item_id as ord, cast(item_id as varchar) as id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as data from benchmark)"
TURNS = "turns as (select turn as ord, cast(conv_id as varchar) as id, coalesce(text, '') as data from conversations)"
