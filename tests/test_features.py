"""Features: selection, lists and intervals on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import locations as L
from helixframe.operators import intervals, rows


def features(spark, items):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "ord long, seqid string, type string, start long, stop long, strand string, meta_json string")


@pytest.fixture(scope="module")
def few(spark):
    return features(spark, [("a", "CDS", 0, 30, "+", '{"score_x": 1}'), ("a", "exon", 5, 10, "+", None), ("b", "cds", 3, 9, "-", '{"gene": "g1"}'), ("b", "gene", 3, 9, "-", '{"gene": "G2"}')])


def ords(df):
    return sorted(r["ord"] for r in df.collect())


def test_select(few):
    assert ords(rows.select(few, "cds")) == [0, 2]
    assert ords(rows.select(few, ["CDS", "exon"], len_min=6)) == [0, 2]
    assert ords(rows.select(few, strand="-", start_le=3)) == [2, 3]
    assert ords(rows.select(few, gene_lowerin=["g2"])) == [3]
    assert ords(rows.select(few, type_notlowereq="cds")) == [1, 3]


def test_select_on_what_is_missing(few):
    assert ords(rows.select(few, nothing="x")) == []
    assert ords(rows.select(few, nothing_noteq="x")) == [0, 1, 2, 3]
    assert ords(rows.select(few, nothing_ne="x")) == [0, 1, 2, 3]


def test_list_algebra(few):
    n, head = few.count(), few.filter("ord < 1")
    assert rows.list_and(few, head).count() == 1 and rows.list_or(few, head).count() == n
    assert rows.list_sub(few, head).count() == n - 1 and rows.list_xor(few, head).count() == n - 1
    both = rows.list_add(few, head)
    assert both.count() == n + 1 and ords(both) == [0, 1, 2, 3, 4]


def test_items_and_slices(few):
    assert ords(rows.item(few, -1)) == [3]
    assert [r["type"] for r in rows.list_slice(few, None, None, -1).orderBy("ord").collect()] == ["gene", "cds", "exon", "CDS"]
    assert [r["type"] for r in rows.list_slice(few, 1, -1).orderBy("ord").collect()] == ["exon", "cds"]
    turned = rows.renumber(few, F.col("ord").desc())
    assert [r["type"] for r in turned.orderBy("ord").collect()] == ["gene", "cds", "exon", "CDS"]


def test_sort_is_stable(few):
    assert [r["ord"] for r in rows.sort(few, "start", reverse=True).collect()] == [1, 2, 3, 0]


def test_groups(few):
    found = {r["seqid"]: (r["n"], [x["type"] for x in r["rows"]]) for r in rows.group_lists(few).collect()}
    assert found == {"a": (2, ["CDS", "exon"]), "b": (2, ["cds", "gene"])}
    assert {r["seqid"]: r["ord"] for r in rows.todict(few, "seqid").collect()} == {"a": 1, "b": 3}


def test_defects(spark):
    d = spark.createDataFrame([(x, x) for x in range(256)], "d int, e int")
    for r in d.select("e", L.reverse_defect(F.col("d")).alias("x"), L.reverse_defect(L.reverse_defect(F.col("d"))).alias("y")).collect():
        assert r["y"] == r["e"]
        assert r["x"] & 192 == r["e"] & 192 and bool(r["x"] & 1) == bool(r["e"] & 2) and bool(r["x"] & 16) == bool(r["e"] & 32)


def brute_nested(items):
    return [i for i, a in enumerate(items) if not any(i != j and b[0] == a[0] and b[1] <= a[1] and a[2] <= b[2] and ((b[1], b[2]) != (a[1], a[2]) or j < i) for j, b in enumerate(items))]


def brute_overlapping(items):
    kept = []
    for i, a in enumerate(items):
        if not any(items[j][0] == a[0] and items[j][1] < a[2] and items[j][2] > a[1] for j in kept):
            kept.append(i)
    return kept


def test_nested_and_overlapping_against_loops(spark):
    rng = random.Random(5)
    items = [(rng.choice("ab"), s := rng.randint(0, 60), s + rng.randint(1, 20)) for _ in range(120)]
    f = features(spark, [(q, f"t{i}", s, e, "+", None) for i, (q, s, e) in enumerate(items)])
    assert ords(intervals.remove_nested(f)) == brute_nested(items)
    assert ords(intervals.remove_overlapping(f)) == brute_overlapping(items)
    pairs = {(r["a_ord"], r["b_ord"]) for r in intervals.overlap_join(f, f, 8).filter("a_ord < b_ord").collect()}
    assert pairs == {(i, j) for i, a in enumerate(items) for j, b in enumerate(items) if i < j and a[0] == b[0] and a[1] < b[2] and a[2] > b[1]}


@pytest.mark.parametrize("scale", [1, intervals.BUCKET // 10])
def test_nested_across_sequences(spark, scale):
    """Equal to the loop within and across buckets, and no task reads all features: only buckets are ordered as a whole."""
    rng = random.Random(6)
    items = [("", s := scale * rng.randint(0, 300), s + scale * rng.randint(1, 9) - rng.randint(0, 1) * (scale > 1)) for _ in range(200)]
    items += [("", items[0][1], items[0][2]), ("", -5 * scale, -3 * scale)]
    f = features(spark, [(rng.choice("ab"), f"t{i % 3}", s, e, "+", None) for i, (_, s, e) in enumerate(items)])
    found = intervals.remove_nested(f, by=None)
    assert ords(found) == brute_nested(items) and found.columns == f.columns
    assert ords(intervals.remove_nested(f, by=None, columns=["start", "stop", "type"])) == brute_nested(items)
    assert "windowspecdefinition(start" not in found._jdf.queryExecution().toString()


def test_reverse_twice(spark, few):
    located = few.withColumn("locs", F.array(L.location(F.col("start"), F.col("stop"), F.col("strand"))))
    twice = intervals.reverse_features(intervals.reverse_features(located, 100), 100)
    assert sorted(map(str, twice.select(*located.columns).collect()))[0] and {(r["ord"], r["start"], r["stop"], r["strand"]) for r in twice.collect()} == {(r["ord"], r["start"], r["stop"], r["strand"]) for r in few.collect()}
    cut = intervals.slice_features(located, 4, 8, rel=4).orderBy("ord").collect()
    assert [(r["start"], r["stop"], r["defect"]) for r in cut] == [(0, 4, 3), (1, 4, 2), (0, 4, 3), (0, 4, 3)]
