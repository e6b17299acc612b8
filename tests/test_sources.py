"""Formats: parsing, round trips, detection, archives, index."""

import itertools
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.sources import fastaindex, io, parsers, writers
from helixframe.sources.locgrammar import parse_location

FASTA = ">s1 first one\nACGT\nACGTA\nAC\n\n>gb|X12|y second\nGGGTTT\n>s3\nMKVL\n"
GFF = "##gff-version 3\nc1\tsrc\tCDS\t1\t3\t.\t+\t0\tID=a;Note=x%2Cy,z\nc1\tsrc\tCDS\t7\t9\t.\t+\t0\tID=a;Note=x%2Cy,z\nc1\tsrc\texon\t5\t9\t2.5\t-\t.\tName=n\n##FASTA\n>c1\nACGTACGTAC\n"
GENBANK = """LOCUS       AB1   12 bp  DNA
DEFINITION  test seq
ACCESSION   AB1 X
FEATURES             Location/Qualifiers
     source          1..12
                     /organism="Homo"
                     /pseudo
     CDS             complement(join(1..3,7..>9))
                     /translation="MK
                     VL"
ORIGIN
        1 acgtacgtac gt
//
"""
EMBL = 'ID   X1; SV 1; linear; DNA; STD; 12 BP.\nAC   X1; X2;\nDE   hello\nDE   world\nFT   CDS             2..7\nFT                   /gene="q"\nSQ   Sequence 12 BP;\n     acgtacgtac gt        12\n//\n'
STOCKHOLM = "# STOCKHOLM 1.0\n#=GF ID UP\n#=GF RT a\n#=GF RT b\ns1 AC-G\n#=GR s1 SS ....\ns2 ACCG\n#=GC SS_cons <<>>\n//\n# STOCKHOLM 1.0\nq AAA\n//\n"
HIT = "q1\ts1\t99.0\t10\t0\t0\t1\t10\t20\t11\t1e-5\t50.1\n"


def seqs(df):
    return [(r["id"], r["data"]) for r in df.orderBy("ord").collect()]


def places(df):
    return [(r["seqid"], r["type"], r["strand"], [(x["start"], x["stop"]) for x in r["locs"]]) for r in df.orderBy("ord").collect()]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    found = io.read(spark, str(tmp_path / "a.fasta"))
    assert seqs(found) == [("s1", "ACGTACGTAAC"), ("X12", "GGGTTT"), ("s3", "MKVL")]
    assert [r["type"] for r in found.orderBy("ord").collect()] == ["nt", "nt", "aa"]
    assert seqs(io.from_string(spark, writers.to_string(found, "fasta"))) == seqs(found)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "a.fasta", "a.fasta")
    assert seqs(io.read(spark, str(tmp_path / "z.zip"))) == seqs(found)


def test_fasta_index(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    index = fastaindex.build_index(spark, str(tmp_path / "a.fasta"))
    got = fastaindex.fetch(index, ["s1", ("s1", 3, 6), ("s3", None, 2), ("s1", 5, None)])
    assert [r["data"] for r in got.collect()] == ["ACGTACGTAAC", "TAC", "MK", "CGTAAC"]
    with pytest.raises(KeyError):
        fastaindex.fetch(index, ["nobody"])
    assert fastaindex.parse_request("s1,3,-") == ("s1", 3, None)


def test_gff(spark, tmp_path):
    (tmp_path / "x.gff").write_text(GFF)
    found = io.read_fts(spark, str(tmp_path / "x.gff"))
    expected = [("c1", "CDS", "+", [(0, 3), (6, 9)]), ("c1", "exon", "-", [(4, 9)])]
    assert places(found) == expected
    assert seqs(io.read(spark, str(tmp_path / "x.gff"))) == [("c1", "ACGTACGTAC")]
    text = writers.to_string(found, "gff")
    assert "Note=x%2Cy,z" in text and places(io.from_string(spark, text, what="fts")) == expected
    writers.write(found, str(tmp_path / "out.gff"))
    assert places(io.read_fts(spark, str(tmp_path / "out.gff"))) == expected
    assert io.read_fts(spark, str(tmp_path / "x.gff"), filt=("exon",)).count() == 1


def test_gff_errors_have_line_numbers():
    with pytest.raises(ValueError, match="Parsing error in line 2"):
        list(parsers.parse_gff("##gff-version 3\nc1\ts\tCDS\t1\t3\t.\t+\t0\tbroken\n"))


def test_gtf():
    found = list(parsers.parse_gff('c1\ts\texon\t1\t3\t.\t+\t0\tgene_id "g"; transcript_id "t";\n', gtf=True))
    assert found[0]["id"] == "g" and found[0]["meta"]["transcript_id"] == "t" and found[0]["meta"]["frame"] == 0


@pytest.mark.parametrize("fmt", ["tsv", "csv", "sjson", "gff"])
def test_feature_round_trips(spark, fmt):
    found = io.from_string(spark, GFF, what="fts")
    again = io.from_string(spark, writers.to_string(found, fmt), what="fts")
    assert [(r["type"], r["start"], r["stop"], r["strand"]) for r in again.orderBy("ord").collect()] == [(r["type"], r["start"], r["stop"], r["strand"]) for r in found.orderBy("ord").collect()]


@pytest.mark.parametrize("fmt", ["fasta", "clustal", "stockholm", "sjson"])
def test_sequence_round_trips(spark, fmt):
    found = spark.createDataFrame([(0, "a", "ACG-T" * 30, None, "{}"), (1, "b", "ACGGT" * 30, None, "{}")], "ord long, id string, data string, header string, meta_json string")
    assert seqs(io.from_string(spark, writers.to_string(found, fmt))) == seqs(found)


def test_genbank(spark):
    assert seqs(io.from_string(spark, GENBANK)) == [("AB1", "ACGTACGTACGT")]
    found = io.from_string(spark, GENBANK, what="fts").orderBy("ord").collect()
    assert [r["type"] for r in found] == ["source", "CDS"]
    assert [(x["start"], x["stop"], x["defect"]) for x in found[1]["locs"]] == [(6, 9, 8), (0, 3, 0)]
    assert '"translation": "MKVL"' in found[1]["meta_json"] and '"misc": ["pseudo"]' in found[0]["meta_json"]
    assert io.from_string(spark, GENBANK, exclude=("seq",)).first()["data"] == ""


def test_embl(spark):
    found = io.from_string(spark, EMBL)
    assert seqs(found) == [("X1", "ACGTACGTACGT")] and '"definition": "hello world"' in found.first()["meta_json"]
    assert places(io.from_string(spark, EMBL, what="fts")) == [("X1", "CDS", "+", [(1, 7)])]


def test_stockholm(spark, tmp_path):
    (tmp_path / "m.stk").write_text(STOCKHOLM)
    found = io.read(spark, str(tmp_path / "m.stk"))
    assert seqs(found) == [("s1", "AC-G"), ("s2", "ACCG"), ("q", "AAA")]
    assert '"RT": "a b"' in found.orderBy("ord").first()["meta_json"]


def test_hits(spark):
    found = io.from_string(spark, HIT, what="fts").first()
    assert (found["fmt"], found["start"], found["stop"], found["strand"], found["score"]) == ("blast", 10, 20, "-", 50.1)
    assert io.from_string(spark, HIT.replace("99.0", "0.99"), what="fts").first()["fmt"] == "mmseqs"
    assert io.from_string(spark, HIT.replace("\t", ","), fmt="blast", what="fts").first()["start"] == 10


def test_infernal():
    dashes = "#" + " ".join(["---"] * 18)
    line = "s1 - q1 RF1 cm 1 50 90 41 - no 1 0.5 0.0 33.3 1e-9 ! some words here"
    found = list(parsers.parse_infernal(f"#target name\n{dashes}\n{line}\n"))
    assert (found[0]["seqid"], found[0]["name"], found[0]["locs"][0]["start"], found[0]["locs"][0]["stop"], found[0]["meta"]["description"]) == ("s1", "q1", 40, 90, "some words here")


# fixed values: locations of the public feature table document
@pytest.mark.parametrize("text,expected", [("467", (466, 467, 0)), ("340..565", (339, 565, 0)), ("<345..500", (344, 500, 4)), ("1..>888", (0, 888, 8)), ("102.110", (101, 110, 128)), ("123^124", (122, 124, 64))])
def test_location_grammar(text, expected):
    found = parse_location(text)[0]
    assert (found["start"], found["stop"], found["defect"]) == expected


def test_annotation_rows():
    found = parsers.row_to_features("|aa-|--bb--|c", "x", "s")
    assert [(f["name"], f["locs"][0]["start"], f["locs"][0]["stop"], f["locs"][0]["defect"]) for f in found] == [("aa", 0, 5, 0), ("bb", 4, 12, 0), ("c", 11, 13, 2)]


def test_what_is_empty_or_unknown(spark, tmp_path):
    (tmp_path / "empty.fa").write_text("")
    with pytest.raises(OSError, match="empty"):
        io.read(spark, str(tmp_path / "empty.fa"))
    with pytest.raises(OSError, match="detected"):
        io.from_string(spark, "what is this")
    assert io.detect_ext("x.fna") == "fasta" and io.detect_ext("x.gtf", "fts") == "gtf" and io.detect_ext("x") is None


BY_LINE = {
    "gff": (["##gff-version 3"], ["c\tx\tCDS\t1\t3\t.\t+\t.\tName=n"]),
    "gtf": ([], ['c\tx\texon\t1\t3\t.\t+\t.\tgene_id "g";']),
    "tsv": (["seqid\ttype\tstart\tstop"], ["c\tCDS\t0\t3"]),
    "csv": (["type,start,len"], ["CDS,0,3"]),
    "blast": (["# BLASTN", "# Fields: query id, subject id, s. start, s. end"], ["q\tc\t1\t3"]),
    "mmseqs": (["query\ttarget\ttstart\ttend"], ["q\tc\t1\t3"]),
    "infernal": (["#" + " ".join(["---"] * 18)], ["c - q - cm 1 50 1 3 + no 1 0.5 0.0 33.3 1e-9 ! words"]),
    "meme_txt": (["*", "MEME"], ["MOTIF M1 MEME-1 width = 3 E-value = 1e-4", "\tsites sorted by position p-value", "------------", "c + 1 1e-3 A CGT G", "------------"]),
}


@pytest.mark.parametrize("fmt", sorted(BY_LINE))
def test_features_come_while_lines_are_read(fmt):
    """A file's text is never held whole: endless lines give their first features."""
    head, lines = BY_LINE[fmt]
    endless = itertools.chain(head, itertools.cycle(lines))
    found = list(itertools.islice(io.FORMATS[fmt].parse_fts(endless), 3))
    assert [(f["locs"][0]["start"], f["locs"][0]["stop"]) for f in found] == [(0, 3)] * 3


@pytest.mark.parametrize("fmt", sorted(BY_LINE))
def test_one_file_read_by_many_tasks(spark, tmp_path, fmt):
    """Lines keep their file's head and order, and batches are small, however Spark cuts the file."""
    head, lines = BY_LINE[fmt]
    n = 3 * io.ROWS
    for name in "ab":
        (tmp_path / name).write_text("\n".join(["", *head, *lines * n, ""]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        texts, by_line = io._texts(spark, str(tmp_path), io.FORMATS[fmt])
        assert by_line and texts.count() >= 2 * n * len(lines)
        found = io.read_fts(spark, str(tmp_path), fmt).orderBy("ord").select("ord", "src_file", "start", "stop").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["ord"] for r in found] == list(range(2 * n)) and {(r["start"], r["stop"]) for r in found} == {(0, 3)}
    assert [r["src_file"].rsplit("/", 1)[1] for r in found] == ["a"] * n + ["b"] * n


def test_features_of_many_locations_over_many_tasks(spark, tmp_path):
    lines = [f"c\tx\tCDS\t{3 * k + 1}\t{3 * k + 2}\t.\t+\t.\tID=f{k // 5000}" for k in range(10000)]
    (tmp_path / "x.gff").write_text("\n".join(["##gff-version 3", *lines, "##FASTA", ">c", "ACGT"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        found = io.read_fts(spark, str(tmp_path / "x.gff")).orderBy("ord").collect()
        assert seqs(io.read(spark, str(tmp_path / "x.gff"))) == [("c", "ACGT")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["id"], r["start"], r["stop"], len(r["locs"])) for r in found] == [("f0", 0, 14999, 5000), ("f1", 15000, 29999, 5000)]


@pytest.mark.parametrize("fmt,text", [("genbank", GENBANK), ("embl", EMBL)])
@pytest.mark.parametrize("what", ["seqs", "fts"])
def test_many_records_take_few_batches(fmt, text, what):
    wanted = to_arrow_schema(T._parse_datatype_string(io.SEQS if what == "seqs" else io.FTS))
    own = io.FORMATS[fmt]
    texts = pa.RecordBatch.from_pydict({"src_file": ["a"] * 999 + ["b"], "block": [0] * 900 + [7] * 100, "text": [text] * 1000})
    found = list(io.parsed_batches(iter([texts, texts]), own.parse if what == "seqs" else own.parse_fts, what, {}, False, wanted))
    each = found[0].num_rows // 900
    assert [(b["src_file"][0].as_py(), b["block"][0].as_py(), b.num_rows) for b in found] == [("a", 0, 900 * each), ("a", 7, 99 * each), ("b", 7, each)] * 2
    assert found[0]["row"].to_pylist() == list(range(900 * each))
    long = texts.slice(0, 100).set_column(2, "text", pa.array([text.replace("acgtacgtac", "a" * 100000)] * 100))
    if what == "seqs":
        assert len(list(io.parsed_batches(iter([long]), own.parse, what, {}, False, wanted))) == 3
