"""A corpus pipeline of five stages over `documents`.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results: an empty table stays empty through every stage; null and empty texts fall to the quality rules; of
repeated rows one stays; other columns, whatever their names, are kept up to the last stage, which looks at doc_id and
text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import fresh_path
from helixframe.llm.decontaminate import drop_contaminated
from helixframe.llm.near_dedup import drop_near_duplicates
from helixframe.llm.packing import pack_documents
from helixframe.llm.quality import filter_quality
from helixframe.llm.queries import vocabulary
from helixframe.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id, stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, cut into pieces and packed into sequences of at most 4096 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Sketches, automata and tokenizers are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None
