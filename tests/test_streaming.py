from helixframe.streaming.files import stream


def test_stream_of_fasta_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text(">a\nACGT\n>b\nGG\n")
    s = stream(spark, str(tmp_path / "in"), "fasta")
    q = s.writeStream.format("memory").queryName("seqs_seen").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        (tmp_path / "in/c.fasta").write_text(">c\nMKVL\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["id"], r["data"], r["type"]) for r in spark.table("seqs_seen").collect()) == [("a", "ACGT", "nt"), ("b", "GG", "nt"), ("c", "MKVL", "aa")]
