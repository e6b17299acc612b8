"""Interval algebra on columns: strands, defects, locations and their ranges.

A location is STRUCT<start, stop, strand, defect, meta_json>, half open and 0-based. A feature has a non-empty ARRAY
of them on one strand, ordered by start, or by stop downwards on the minus strand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATION = "struct<start:bigint,stop:bigint,strand:string,defect:int,meta_json:string>"

#: Bits of a location's defects.
DEFECTS = {"NONE": 0, "MISS_LEFT": 1, "MISS_RIGHT": 2, "BEYOND_LEFT": 4, "BEYOND_RIGHT": 8, "UNKNOWN_LEFT": 16, "UNKNOWN_RIGHT": 32, "BETWEEN_CONSECUTIVE": 64, "UNKNOWN_SINGLE_BETWEEN": 128}


def reverse_strand(strand: Column) -> Column:
    return F.when(strand == "+", "-").when(strand == "-", "+").otherwise(strand)


def reverse_defect(defect: Column) -> Column:
    """Left and right bits change places, the others stay."""
    left, right = defect.bitwiseAND(F.lit(21)), defect.bitwiseAND(F.lit(42))
    return F.shiftleft(left, 1).bitwiseOR(F.shiftright(right, 1)).bitwiseOR(defect.bitwiseAND(F.lit(192))).cast("int")


def location(start: Column, stop: Column, strand: Column, defect: Column | None = None, meta: Column | None = None) -> Column:
    defect = F.lit(0) if defect is None else defect
    meta = F.lit(None).cast("string") if meta is None else meta
    return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), strand.alias("strand"), defect.cast("int").alias("defect"), meta.alias("meta_json"))


def range_start(locs: Column) -> Column:
    return F.array_min(F.transform(locs, lambda x: x["start"]))


def range_stop(locs: Column) -> Column:
    return F.array_max(F.transform(locs, lambda x: x["stop"]))


def middle(start: Column, stop: Column) -> Column:
    return F.floor((start + stop) / 2).cast("long")


def sort_locations(locs: Column) -> Column:
    """By start; on the minus strand by stop, largest first."""
    forward = F.array_sort(locs, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["stop"] - b["stop"])).cast("int"))
    backward = F.array_sort(locs, lambda a, b: F.when(a["stop"] != b["stop"], F.signum(b["stop"] - a["stop"])).otherwise(F.signum(b["start"] - a["start"])).cast("int"))
    return F.when(locs[0]["strand"] == "-", backward).otherwise(forward)


def shift_locations(locs: Column, offset: Column | int) -> Column:
    return F.transform(locs, lambda x: location(x["start"] + offset, x["stop"] + offset, x["strand"], x["defect"], x["meta_json"]))


def reverse_locations(locs: Column, length: Column | int) -> Column:
    """As seen from the other strand of a sequence of that length."""
    turned = F.transform(locs, lambda x: location(F.lit(length) - x["stop"] if isinstance(length, int) else length - x["stop"], (F.lit(length) if isinstance(length, int) else length) - x["start"], reverse_strand(x["strand"]), reverse_defect(x["defect"]), x["meta_json"]))
    return sort_locations(turned)


def clip_locations(locs: Column, start: Column | None, stop: Column | None, offset: Column | int = 0) -> Column:
    """Locations inside [start, stop), cut at its ends and marked where they were; places count from offset."""
    inside = F.filter(locs, lambda x: (F.lit(True) if stop is None else x["start"] < stop) & (F.lit(True) if start is None else x["stop"] > start))

    def cut(x: Column) -> Column:
        low = F.lit(False) if start is None else x["start"] < start
        high = F.lit(False) if stop is None else x["stop"] > stop
        begin = x["start"] if start is None else F.greatest(x["start"], start)
        end = x["stop"] if stop is None else F.least(x["stop"], stop)
        defect = x["defect"].bitwiseOR(F.when(low, 1).otherwise(0)).bitwiseOR(F.when(high, 2).otherwise(0))
        return location(begin - offset, end - offset, x["strand"], defect, x["meta_json"])

    return F.transform(inside, cut)


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    return (a_start < b_stop) & (a_stop > b_start)


def compare(start_a: Column, stop_a: Column, start_b: Column, stop_b: Column) -> Column:
    """-1, 0 or 1 as range a comes before, with or behind range b: by start, then by stop."""
    before = (start_a < start_b) | ((start_a == start_b) & (stop_a < stop_b))
    same = (start_a == start_b) & (stop_a == stop_b)
    return F.when(before, -1).when(same, 0).otherwise(1)


def contains(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    return (a_start <= b_start) & (b_stop <= a_stop)


def overlap_length(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_stop, b_stop) - F.greatest(a_start, b_start))


def distance(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column, pos: str = "inner", sign: bool = False) -> Column:
    """0 where they overlap; else the gap between the nearest ends, or the difference of the middles.

    With sign, the distance is negative if the other (b) lies before.
    """
    if pos == "inner":
        apart = F.greatest(b_start - a_stop, a_start - b_stop)
    elif pos == "middle":
        apart = F.abs(middle(b_start, b_stop) - middle(a_start, a_stop))
    else:
        raise ValueError("pos is inner or middle")
    signed = F.when(b_start < a_start, -apart).otherwise(apart) if sign else apart
    return F.when(overlaps(a_start, a_stop, b_start, b_stop), F.lit(0).cast("long")).otherwise(signed.cast("long"))
