"""Sequences as objects of other libraries, on the driver; the libraries are optional."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def to_biopython(seqs: DataFrame) -> list:
    """Bio.SeqRecord objects, in list order."""
    from Bio.Seq import Seq
    from Bio.SeqRecord import SeqRecord

    return [SeqRecord(Seq(r["data"]), id=r["id"] or "") for r in seqs.orderBy("ord").select("id", "data").toLocalIterator()]


def from_biopython(spark: SparkSession, records) -> DataFrame:
    rows = [(k, r.id, str(r.seq).upper()) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, "ord long, id string, data string")


def to_biotite(seqs: DataFrame) -> list:
    """biotite NucleotideSequence or ProteinSequence objects; gaps are left out."""
    from biotite.sequence import NucleotideSequence, ProteinSequence

    from ..functions.sequence import sequence_type

    rows = seqs.orderBy("ord").select("data", sequence_type("data").alias("type")).toLocalIterator()
    return [(NucleotideSequence if r["type"] == "nt" else ProteinSequence)(r["data"].replace("-", "").replace(".", "").replace("U", "T")) for r in rows]


def from_biotite(spark: SparkSession, sequences, ids=None) -> DataFrame:
    rows = [(k, ids[k] if ids else "", str(s)) for k, s in enumerate(sequences)]
    return spark.createDataFrame(rows, "ord long, id string, data string")
