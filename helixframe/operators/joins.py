"""Attaching features to sequences and cutting sequences by features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .rows import first_of_type


def attach(seqs: DataFrame, fts: DataFrame) -> DataFrame:
    """(seq_ord, feature columns) of features whose seqid a sequence has; of equal ids the first sequence gets them.

    Features that are left over are leftover(seqs, fts).
    """
    owner = seqs.groupBy("id").agg(F.min("ord").alias("seq_ord"))
    return fts.join(owner, fts["seqid"] == owner["id"]).select("seq_ord", *(fts[c] for c in fts.columns))


def leftover(seqs: DataFrame, fts: DataFrame) -> DataFrame:
    """Features whose seqid no sequence has."""
    return fts.join(seqs.select(F.col("id").alias("_id")).distinct(), F.col("seqid") == F.col("_id"), "left_anti")


def attach_more(old: DataFrame, seqs: DataFrame, fts: DataFrame) -> DataFrame:
    """Features that sequences have already, and new ones, each sequence's ordered by position."""
    both = old.unionByName(attach(seqs, fts).select(*old.columns))
    return both.orderBy("seq_ord", "start", "stop", "ord")


def slice_locations(data: Column, locs: Column, splitter: str = "", filler: str | None = None) -> Column:
    """The parts of data at the locations, joined; those on the minus strand reverse-complemented.

    Locations are in their feature's order. filler, repeated, stands for the places between two parts; splitter is put
    between parts.
    """

    def part(x: Column) -> Column:
        text = F.substring(data, x["start"].cast("int") + 1, (x["stop"] - x["start"]).cast("int"))
        return F.when(x["strand"] == "-", reverse_complement(text)).otherwise(text)

    if filler is None:
        return F.array_join(F.transform(locs, part), splitter)

    def with_gap(x: Column, i: Column) -> Column:
        before = F.get(locs, i - 1)
        between = F.when(x["strand"] == "-", before["start"] - x["stop"]).otherwise(x["start"] - before["stop"])
        gap = F.when(i == 0, F.lit("")).otherwise(F.repeat(F.lit(filler), F.greatest(between, F.lit(0)).cast("int")))
        return F.concat(gap, part(x))

    return F.array_join(F.transform(locs, with_gap), splitter)


def extract(seqs: DataFrame, fts: DataFrame, splitter: str = "", filler: str | None = None) -> DataFrame:
    """A sequence for each pair of a feature and a sequence of its seqid, ordered by feature and then sequence."""
    own = fts.select(F.col("ord").alias("ft_ord"), "seqid", F.col("type").alias("ft_type"), "locs")
    joined = seqs.join(own, seqs["id"] == own["seqid"])
    out = joined.withColumn("data", slice_locations(F.col("data"), F.col("locs"), splitter, filler))
    return out.select("ft_ord", *seqs.columns, "ft_type")


def extract_type(seqs: DataFrame, fts: DataFrame, type: str, strict: bool = True) -> DataFrame:  # noqa: A002
    """Each sequence cut to its first feature of the type; without one it fails, or goes if not strict."""
    first = first_of_type(fts, type, by="seqid").select(F.col("seqid").alias("_seqid"), F.col("locs").alias("_locs"))
    joined = seqs.join(first, seqs["id"] == first["_seqid"], "left" if strict else "inner")
    cut = slice_locations(F.col("data"), F.col("_locs"))
    missing = F.raise_error(F.concat(F.lit(f"no feature of type {type} in sequence "), F.coalesce("id", F.lit("?"))))
    return joined.withColumn("data", F.when(F.col("_locs").isNull(), missing).otherwise(cut) if strict else cut).select(*seqs.columns)


def attach_one(seqs: DataFrame, fts: DataFrame, ord_: int, replace: bool = True, old: DataFrame | None = None) -> DataFrame:
    """(seq_ord, feature columns) with fts as the features of sequence ord_, whatever their seqid.

    old: the features attached so far; replace takes ord_'s away, else the new ones join them, ordered by place.
    """
    owner = seqs.filter(F.col("ord") == ord_).select(F.col("ord").alias("seq_ord"))
    new = fts.join(F.broadcast(owner), how="cross").select("seq_ord", *fts.columns)  # one row
    if old is None:
        return new
    rest = old.filter(F.col("seq_ord") != ord_) if replace else old
    return rest.select(*new.columns).unionByName(new).orderBy("seq_ord", "start", "stop", "ord")


def concatenate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sequence by sequence (of equal ord), a's data followed by b's; all else is a's."""
    other = b.select("ord", F.col("data").alias("_more"))
    return a.join(other, "ord").withColumn("data", F.concat("data", "_more")).select(*a.columns)


def first_of_id(seqs: DataFrame) -> DataFrame:
    """The first sequence of each id."""
    w = Window.partitionBy("id").orderBy("ord")
    return seqs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
