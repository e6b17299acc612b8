"""Counts of letters and words, and merging of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import kmers
from .codes import raw, word_texts, words_of


def words(seqs: DataFrame, k: int = 1) -> DataFrame:
    """(ord, id, word) of every overlapping word, exploded lazily; for counts see count_words and word_table."""
    return seqs.select("ord", "id", F.explode(kmers("data", k)).alias("word"))


def _counted(seqs: DataFrame, k: int, each: bool) -> DataFrame:
    """(ord, id, word, n) of each sequence, or (word, n) of each batch of them, counted as numbers of k <= 8 bytes."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            letters, offsets = raw(batch.column(2))
            if each:
                parts = [words_of(letters, offsets[i : i + 2], k)[0] for i in range(len(offsets) - 1)]
                found = [np.unique(p, return_counts=True) for p in parts]
                row = np.repeat(np.arange(len(found)), [len(w) for w, _ in found])
                numbers, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                first = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))]
            else:
                numbers, inside = words_of(letters, offsets, k)
                numbers, n = np.unique(numbers[inside], return_counts=True)
                first = []
            yield pa.RecordBatch.from_arrays([*first, pa.array(word_texts(numbers, k), pa.string()), pa.array(n, pa.int64())], names=[*(("ord", "id") if each else ()), "word", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in seqs.schema}
    schema = f"ord {kinds['ord']}, id {kinds['id']}, word string, n long" if each else "word string, n long"
    return seqs.select("ord", "id", "data").mapInArrow(run, schema)


def _counts(seqs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Words counted in one vectorised pass where they are ASCII and of at most 8 letters, by expressions elsewhere."""
    if k > 8:
        return words(seqs, k).groupBy(*keys, "word").agg(F.count("*").alias("count"))
    ascii_ = F.octet_length("data") == F.length("data")
    quick = _counted(seqs.filter(ascii_), k, bool(keys)).select(*keys, "word", "n")
    other = words(seqs.filter(~ascii_), k).select(*keys, "word", F.lit(1).cast("long").alias("n"))
    return quick.unionByName(other).groupBy(*keys, "word").agg(F.sum("n").alias("count"))


def count_words(seqs: DataFrame, k: int = 1) -> DataFrame:
    """(word, count) over the whole basket."""
    return _counts(seqs, k, [])


def word_probabilities(seqs: DataFrame, k: int = 1) -> DataFrame:
    """(word, count, prob): shares of all words; the total is one row."""
    counts = count_words(seqs, k)
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.join(F.broadcast(total), how="cross").select("word", "count", (F.col("count") / F.col("_total")).alias("prob"))


def word_table(seqs: DataFrame, k: int = 1) -> DataFrame:
    """(ord, id, word, count, prob, tprob): counts of each sequence, their share among its id's and among all words.

    Counts are made once by (ord, id, word); totals by id and in all are made of those counts.
    """
    counts = _counts(seqs, k, ["ord", "id"])
    by_id = Window.partitionBy("id")
    total = counts.agg(F.sum("count").alias("_total"))
    shared = counts.withColumn("_of_id", F.sum("count").over(by_id)).join(F.broadcast(total), how="cross")
    return shared.select("ord", "id", "word", "count", (F.col("count") / F.col("_of_id")).alias("prob"), (F.col("count") / F.col("_total")).alias("tprob"))


def merge(seqs: DataFrame, spacer: str = "", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One sequence for each key: data in list order with the spacer between, other columns from the first."""
    rest = [c for c in seqs.columns if c not in keys and c != "data"]
    row = F.struct("ord", "data")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["data"]), spacer)
    grouped = seqs.groupBy(*keys).agg(joined.alias("data"), *(F.min_by(c, "ord").alias(c) for c in rest))
    return grouped.select(*seqs.columns)


def merge_offsets(seqs: DataFrame, spacer: str = "", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """seqs with the offset of each sequence in its merged one."""
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    step = F.length("data") + len(spacer)
    return seqs.withColumn("offset", F.coalesce(F.sum(step).over(before), F.lit(0)).cast("long"))
