"""Queries take whole texts and tables."""

from helixframe.plans import derive
from helixframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def documents(spark, folder, text):
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_matches_far_in_a_text(spark, tmp_path):
    folder = documents(spark, tmp_path, "x " * 300 + "the cat. The dog")
    assert QUERIES["match_regex"].run(spark, folder).first()["n"] == 2


def test_slice_far_in_a_text(spark, tmp_path):
    folder = documents(spark, tmp_path, "abc" + " " * 300 + "DEFGHIJKLMNOPQRSTUVW")
    assert QUERIES["seq_slice_ungapped"].run(spark, folder).first()["part"] == "DEFGHIJKLMNOPQRST"


def test_late_features(spark):
    every = derive.fts(spark, SF)
    found = QUERIES["extract_by_feature"].run(spark, SF).count()
    assert found == every.join(derive.seqs(spark, SF).withColumnRenamed("id", "seqid"), "seqid", "left_semi").count()
    assert QUERIES["list_or"].run(spark, SF).count() == every.count()
