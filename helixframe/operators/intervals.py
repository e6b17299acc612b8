"""Operators on features: clipping, reverse complement, joins of intervals, nested and overlapping features."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locations as L
from .rows import remove_duplicates


def with_range(fts: DataFrame) -> DataFrame:
    """start, stop, strand and defect anew from locs."""
    first = F.col("locs")[0]
    return fts.withColumn("start", L.range_start(F.col("locs"))).withColumn("stop", L.range_stop(F.col("locs"))).withColumn("strand", first["strand"]).withColumn("defect", first["defect"])


def slice_features(fts: DataFrame, start: int | None, stop: int | None, rel: int = 0) -> DataFrame:
    """Parts of features inside [start, stop); features without one go. Narrow."""
    low, high = (None if x is None else F.lit(x) for x in (start, stop))
    return with_range(fts.withColumn("locs", L.clip_locations(F.col("locs"), low, high, rel)).filter(F.size("locs") > 0))


def shift_features(fts: DataFrame, offset: int) -> DataFrame:
    return with_range(fts.withColumn("locs", L.shift_locations(F.col("locs"), offset)))


def reverse_features(fts: DataFrame, length: Column | int = 0) -> DataFrame:
    """Features as seen from the other strand."""
    return with_range(fts.withColumn("locs", L.reverse_locations(F.col("locs"), length)))


def _binned(fts: DataFrame, width: int, prefix: str, names: list[str]) -> DataFrame:
    kept = fts.select(*(F.col(c).alias(f"{prefix}{c}") for c in names))
    bins = F.sequence(F.floor(F.col(f"{prefix}start") / width), F.floor((F.col(f"{prefix}stop") - 1) / width))
    return kept.withColumn(f"{prefix}bin", F.explode(bins))


def overlap_join(a: DataFrame, b: DataFrame, width: int, by: str | None = "seqid", columns: list[str] | None = None) -> DataFrame:
    """Pairs of overlapping ranges as a_*, b_*: an equi-join on (by, bin of `width` places), each pair once.

    A range lies in every bin that it touches; the pair counts in the bin where the later one begins. width should be
    near the usual length: a range is copied length / width + 1 times, and a bin holds what begins within width.
    """
    names = columns or a.columns
    x, y = _binned(a, width, "a_", names), _binned(b, width, "b_", names)
    on = F.col("a_bin") == F.col("b_bin")
    if by:
        on &= F.col(f"a_{by}") == F.col(f"b_{by}")
    first = F.floor(F.greatest("a_start", "b_start") / width) == F.col("a_bin")
    return x.join(y, on & first & L.overlaps(F.col("a_start"), F.col("a_stop"), F.col("b_start"), F.col("b_stop"))).drop("a_bin", "b_bin")


#: Places whose features are compared in one group where sequences aren't told apart.
BUCKET = 1 << 16


def remove_nested(fts: DataFrame, by: str | None = "seqid", columns: list[str] | None = None) -> DataFrame:
    """Features that lie in no other one; of equal ranges the first stays, and of equal features one.

    A feature is nested if one that begins before it, or with it and ends later, or is equal and comes earlier, ends
    no earlier: one running maximum. by=None compares across sequences: of the features that begin at one place only
    the longest can stay, so the maximum runs over those, within buckets of places and then over the buckets.
    """
    if by is None:
        return _remove_nested_anywhere(fts, columns)
    own = remove_duplicates(fts, columns)
    window = Window.partitionBy(by).orderBy("start", F.desc("stop"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("stop").over(window)
    return own.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("stop"))).drop("_reach")


def _remove_nested_anywhere(fts: DataFrame, columns: list[str] | None) -> DataFrame:
    names = fts.columns
    # of equal features with equal ranges the first is the longest and first at its start anyway
    own = fts if columns is None or {"start", "stop"} <= set(columns) else remove_duplicates(fts, columns)
    longest = own.groupBy("start").agg(F.min_by(F.struct(*names), F.struct(-F.col("stop"), F.col("ord"))).alias("r")).select("r.*")
    dealt = longest.withColumn("_bucket", F.floor(F.col("start") / BUCKET))
    sizes = dealt.groupBy("_bucket").agg(F.max("stop").alias("_stop"))  # one row a bucket
    earlier = sizes.select("_bucket", F.max("_stop").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("stop").over(Window.partitionBy("_bucket").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(inside, "_before")  # of those that aren't null
    found = dealt.join(F.broadcast(earlier), "_bucket").withColumn("_reach", reach)
    return found.filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("stop"))).select(*names)


def remove_overlapping(fts: DataFrame, by: str | None = "seqid", columns: list[str] | None = None) -> DataFrame:
    """In list order, features that overlap none that was kept.

    The choice depends on all earlier ones of the group, so a group is one sequential pass; what is kept is a sorted
    list of disjoint ranges, probed by bisection. Groups stream: only the kept ranges are held.
    """
    own = remove_duplicates(fts, columns)
    names = own.columns
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = own.select(F.col(by).alias("by") if by else F.lit("").alias("by"), "ord", "start", "stop")
    dealt = slim.repartition(parts, "by").sortWithinPartitions("by", "ord") if by else slim.coalesce(1).sortWithinPartitions("ord")

    def run(batches: Iterator) -> Iterator:
        import bisect

        import pyarrow as pa

        now, starts, stops = None, [], []
        for batch in batches:
            kept = []
            for group, start, stop in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if group != now or now is None:
                    now, starts, stops = group, [], []
                k = bisect.bisect_right(starts, start)
                good = not (k and stops[k - 1] > start) and not (k < len(starts) and starts[k] < stop)
                if good:
                    starts.insert(k, start)
                    stops.insert(k, stop)
                kept.append(good)
            yield batch.filter(pa.array(kept, pa.bool_())).select(["by", "ord"])

    kind = slim.schema["by"].dataType.simpleString()
    chosen = dealt.mapInArrow(run, f"by {kind}, ord long")
    same = own["ord"] == chosen["ord"]
    if by:
        same &= own[by].eqNullSafe(chosen["by"])
    return own.join(chosen, same, "left_semi").select(*names)


def align_groups(fts: DataFrame, by: str = "seqid", align: str = "center", crop: int | None = None) -> DataFrame:
    """Shift each group so that the groups' anchors coincide at the largest anchor.

    The anchor is the middle of the group's range, or of its first or last feature in list order. crop keeps that many
    places on both sides of the anchor.
    """
    middle = L.middle(F.col("start"), F.col("stop"))
    anchors = {
        "center": L.middle(F.min("start"), F.max("stop")),
        "first": F.min_by(middle, "ord"),
        "last": F.max_by(middle, "ord"),
    }
    if align not in anchors:
        raise ValueError(f"align is one of {', '.join(anchors)}")
    anchor = fts.groupBy(F.col(by).alias("_by")).agg(anchors[align].alias("_anchor"))
    at = anchor.agg(F.max("_anchor").alias("_at"))
    joined = fts.join(anchor, F.col(by).eqNullSafe(F.col("_by"))).join(F.broadcast(at), how="cross")  # one row
    move = F.col("_at") - F.col("_anchor")
    out = joined.withColumn("locs", L.shift_locations(F.col("locs"), move)) if "locs" in fts.columns else joined
    out = out.withColumn("start", F.col("start") + move).withColumn("stop", F.col("stop") + move)
    if crop is not None:
        low, high = F.col("_at") - crop, F.col("_at") + crop
        if "locs" in fts.columns:
            out = with_range(out.withColumn("locs", L.clip_locations(F.col("locs"), low, high)).filter(F.size("locs") > 0))
        else:
            out = out.filter((F.col("start") < high) & (F.col("stop") > low)).withColumn("start", F.greatest("start", low)).withColumn("stop", F.least("stop", high))
    return out.select(*fts.columns)
