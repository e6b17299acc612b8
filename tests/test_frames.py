from pyspark.sql import functions as F

from helixframe.operators import counting, frames, joins
from helixframe.sources import io
from helixframe.sources.entrez import Entrez

HIT = "q1\ts1\t99.0\t10\t0\t0\t3\t12\t20\t11\t1e-5\t50.1\tAC-G\n"


def test_tables(spark):
    t = spark.createDataFrame([(1, 5, "x"), (2, 3, None)], "start long, len long, note string")
    f = frames.from_table(t, ftype="gene", one_based=True)
    assert sorted(map(tuple, frames.columns(f, "type start stop strand note").collect()), key=str) == sorted([("gene", 0, 5, "?", "x"), ("gene", 1, 4, "?", None)], key=str)
    assert len(list(frames.tolists(f, "len"))) == 2


def test_metadata(spark):
    d = spark.createDataFrame([(0, '{"a": {"b": 1}, "c": [1]}'), (1, None)], "ord long, meta_json string")
    found = frames.meta_set(d, "x", "y").orderBy("ord").collect()
    assert [r["meta_json"] for r in found] == ['{"a": {"b": 1}, "c": [1], "x": "y"}', '{"x": "y"}']
    assert d.orderBy("ord").select(frames.meta_get("meta_json", "a.b").alias("v")).first()["v"] == "1"


def test_hits(spark):
    outfmt = "qseqid sseqid pident length mismatch gapopen qstart qend sstart send evalue bitscore sseq"
    hits = io.from_string(spark, HIT, fmt="blast", what="fts", outfmt=outfmt)
    q = frames.query_features(hits).first()
    assert (q["seqid"], q["name"], q["start"], q["stop"], q["strand"]) == ("q1", "s1", 2, 12, "+")
    assert [(r["id"], r["data"]) for r in frames.hit_sequences(hits).collect()] == [("s1", "AC-G")]
    assert frames.hit_sequences(hits, change_id=True).first()["id"] == "s1/11-/e-5"


def test_features_follow_sequences(spark):
    s = spark.createDataFrame([(0, "a", "ACGT"), (1, "a", "GG")], "ord long, id string, data string")
    f = frames.from_table(spark.createDataFrame([(0, "a", 1, 3)], "ord long, seqid string, start long, stop long"))
    attached = joins.attach(s, f)
    moved = frames.merged_features(counting.merge_offsets(s, "--"), attached.withColumn("seq_ord", F.lit(1).cast("long")))
    assert [(r["start"], r["stop"]) for r in moved.collect()] == [(7, 9)]
    g = frames.from_table(spark.createDataFrame([(0, "a", 3, 9)], "ord long, seqid string, start long, stop long"))
    aa = spark.createDataFrame([(0, "a", "MK")], "ord long, id string, data string")
    assert [(r["start"], r["stop"]) for r in frames.translated_features(joins.attach(s, g), aa).collect()] == [(1, 2)]


def test_remote_client(spark, tmp_path):
    asked = []
    client = Entrez(str(tmp_path / "cache"), get=lambda url: asked.append(url) or ">x y\nACGT\n")
    assert client.get_basket(spark, ["x", "x"], rettype="fasta").count() == 2
    assert len(asked) == 1 and "id=x" in asked[0] and client.limit == 3


def test_annotation_rows_come_back(spark):
    from helixframe.sources.parsers import row_to_features

    s = spark.createDataFrame([(0, "a", "A" * 20)], "ord long, id string, data string")
    f = frames.from_table(spark.createDataFrame([(0, "a", "x", 2, 9), (1, "a", "y", 8, 15)], "ord long, seqid string, name string, start long, stop long"))
    row = frames.annotation_rows(f, s).first()["row"]
    assert row == "..|--x--|--y--|....."[: len(row)] and len(row) == 20
    back = [(x["name"], x["locs"][0]["start"], x["locs"][0]["stop"]) for x in row_to_features(row, "t", "a") if x["name"]]
    assert back == [("x", 2, 9), ("y", 8, 15)]


def test_replaced_items(spark):
    s = spark.createDataFrame([(0, "a"), (1, "b")], "ord long, data string")
    new = spark.createDataFrame([(1, "c")], "ord long, data string")
    assert sorted(map(tuple, frames.replace_items(s, new).collect())) == [(0, "a"), (1, "c")]


def test_archives(spark, tmp_path):
    from helixframe.sources import writers

    s = spark.createDataFrame([(0, "a", "ACGT")], "ord long, id string, data string")
    for name in ("x.zip", "x.tar.gz"):
        writers.write_archive(s, str(tmp_path / name), "fasta")
        assert [(r["id"], r["data"]) for r in io.read(spark, str(tmp_path / name)).collect()] == [("a", "ACGT")]
