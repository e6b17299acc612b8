"""Golden values, metamorphic checks and comparisons of built-in with general paths."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import dims, sequence, strings
from helixframe.operators import joins, match, orf
from helixframe.operators import translate as tr
from helixframe.sources import parsers

GOLDEN = "CCCCATGCTGACCTACCCCATCATGTGACCCCCCTGACCCATGCCCTGACCATGCCCC"


def table(spark, texts):
    return spark.createDataFrame([(i, str(i), x) for i, x in enumerate(texts)], "ord long, id string, data string")


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "data string").select(expression.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["".join(rng.choice("ACGTTGA") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["ATG", "TAG", "AT", "", "ATGTAG", "ATGATGTAGA", "ATGATGTAG"]


def test_genetic_codes():
    code = dims.genetic_code(1)
    assert code.amino["GAY"] == "D" and code.amino["CTN"] == "L"
    assert "ATN" in code.maybe_starts and "TAN" in code.maybe_stops
    assert len(dims.GENETIC_CODES) == 27
    assert dims.genetic_code(2).stops == {"TAA", "TAG", "AGA", "AGG"}
    with pytest.raises(KeyError):
        dims.genetic_code(7)


def test_substitution_matrices():
    m = dims.parse_submat("# c\n   A  C\nA  2 -1\nC -1  2\n")
    assert m["A"]["C"] == m["C"]["A"] == -1
    scaled = dims.scale_submat(m, 3)
    assert sum(abs(v) for r in scaled.values() for v in r.values()) == pytest.approx(3)
    assert m["A"]["A"] == 2


@pytest.mark.parametrize("need_start,counts", [("always", (3, 4, 7)), ("never", (2, 6, 6)), ("once", (3, 6, 6))])
def test_orf_counts(spark, need_start, counts):
    s = table(spark, [GOLDEN])
    assert tuple(orf.find_orfs(s, need_start=need_start, nested=n).count() for n in ("no", "other", "all")) == counts


def test_orf_places(spark):
    s = table(spark, [GOLDEN])
    found = {(r.start, r.stop, r.strand, r.rf) for r in orf.find_orfs(s).collect()}
    assert found == {(4, 28, "+", 1), (12, 42, "-", -2), (20, 53, "-", -3), (40, 49, "+", 1)}
    forward = {(r.start, r.stop, r.rf) for r in orf.find_orfs(s, rf="fwd", need_stop=False).collect()}
    assert forward == {(51, 57, 0), (4, 28, 1), (40, 49, 1)}


@pytest.mark.parametrize("need_start,need_stop,nested", list(itertools.product(("always", "never"), (True, False), ("no", "other", "all"))))
def test_orfs_by_functions_equal_those_by_loops(spark, texts, need_start, need_stop, nested):
    s = table(spark, texts)
    columns = ["seq_ord", "start", "stop", "strand", "rf", "has_start", "has_stop"]
    how = {"need_start": need_start, "need_stop": need_stop, "nested": nested}
    native = orf.find_orfs(s, **how).select(*columns)
    general = orf.find_orfs(s, start="AUG|ATG", **how).select(*columns)
    assert sorted(map(tuple, native.collect())) == sorted(map(tuple, general.collect()))


def test_forward_and_backward_make_all(spark, texts):
    s = table(spark, texts)
    assert orf.find_orfs(s, rf="fwd").count() + orf.find_orfs(s, rf="bwd").count() == orf.find_orfs(s).count()


def test_translation_of_gaps_stops_and_starts():
    # M, then A; the second gap is put out, the third isn't; then the stop
    assert tr.translate_text("ATG-GCA--TAA", complete=True) == "MA-*"
    assert tr.translate_text("GATTAACAT", complete=True) == "D*H"
    assert tr.translate_text("ATGGATTAA") == "MD"
    with pytest.raises(ValueError):
        tr.translate_text("GATTAA")


@pytest.mark.parametrize("complete,final_stop,tt", list(itertools.product((True, False), (None, True, False), (1, 27))))
def test_translation_by_functions_equals_the_loop(spark, texts, complete, final_stop, tt):
    more = [*texts, "ATGNNNTAR", "AUGUAA", "ATGYTR"]
    found = [r["x"] for r in table(spark, more).orderBy("ord").select(tr.translate_column("data", complete, final_stop, tt=tt).alias("x")).collect()]
    assert found == [tr.translate_text(x, complete=complete, check_start=False, final_stop=final_stop, tt=tt) for x in more]


def test_translate_table(spark):
    s = table(spark, ["ATGTCTTGAAGG", "ATG-TC-TTGA", "CCC"])
    found = {r["id"]: (r["data"], r["error"]) for r in tr.translate(s, strict=False).collect()}
    assert found["0"] == ("MS", None) and found["1"][0] == "M-S" and found["2"][0] is None and "start" in found["2"][1]


def test_matches(spark):
    text = "CCTAGGGTGAATG"  # TAG at 2, TGA at 7
    found = match.match(table(spark, [text]), "stop", gap=None).orderBy("start").collect()
    assert [r["start"] for r in found] == [text.index("TAG"), text.index("TGA")]
    gapped = match.match(table(spark, ["A-T-GC-TA-A"]), "stop", rf="fwd").collect()
    assert [(r["match"], r["rf"]) for r in gapped] == [("TA-A", 4 % 3)]  # four letters before it
    assert match.match(table(spark, [text]), "stop", gap=None, matchall=False).count() == 1


def test_reverse_complement_twice(spark, texts):
    twice = table(spark, texts).select("data", sequence.reverse_complement(sequence.reverse_complement("data")).alias("x"))
    assert all(r["data"] == r["x"] for r in twice.collect())
    assert one(spark, "ATG", sequence.reverse_complement("data")) == "CAT"
    assert one(spark, "AUGC", sequence.complement("data")) == "UACG"


def test_slices_follow_python(spark, texts):
    s = table(spark, texts[:60])
    for a, b, c in [(2, 9, 1), (-5, -1, 1), (None, None, 2), (None, None, -1), (8, 2, -2), (-3, None, -3), (1, None, 3)]:
        got = [r["x"] for r in s.orderBy("ord").select(sequence.slice_text("data", a, b, c).alias("x")).collect()]
        assert got == [x[a:b:c] for x in texts[:60]], (a, b, c)


def test_ungapped_slice(spark):
    assert one(spark, "AC--GTT-A", sequence.slice_ungapped("data", 1, 4)) == "C--GT"


def test_header_ids(spark):
    cases = {"id42X": "id42X", "id42X,a": "id42X", "id42X;b": "id42X", "id42X|c": "id42X", "id42X d": "id42X", "gi|1|gb|id42X|": "id42X", "sp|id42X|N": "id42X", " id42X": None}
    cases |= {"||gb:Q7|": "Q7", "gb|Q7 first": "Q7", "Q7 like gb|X1|": "Q7", "  gb:Q7": None, "": None, "x|emb|Q7.1;": "Q7.1", "|||": None}
    for header, expected in cases.items():
        assert one(spark, header, sequence.id_from_header("data")) == expected == parsers.header_id(header), header


@pytest.mark.parametrize("text", ["ACGT", "", "aACgt  ", " xx", "AAAA", "a|b|c", "a b  c"])
def test_string_methods_follow_python(spark, text):
    cases = [
        (strings.center("data", 9, "*"), text.center(9, "*")), (strings.center("data", 10, "*"), text.center(10, "*")),
        (strings.ljust("data", 6, "-"), text.ljust(6, "-")), (strings.rjust("data", 6, "-"), text.rjust(6, "-")),
        (strings.count("data", "A"), text.count("A")), (strings.count("data", "AA"), text.count("AA")),
        (strings.find("data", "C"), text.find("C")), (strings.rfind("data", "A"), text.rfind("A")),
        (strings.removeprefix("data", "A"), text.removeprefix("A")), (strings.removesuffix("data", "T"), text.removesuffix("T")),
        (strings.strip("data"), text.strip()), (strings.lstrip("data", "Aa "), text.lstrip("Aa ")), (strings.rstrip("data"), text.rstrip()),
        (strings.replace("data", "A", "xy"), text.replace("A", "xy")), (strings.replace("data", "A", "x", 1), text.replace("A", "x", 1)),
        (strings.split("data"), text.split()), (strings.split("data", "|"), text.split("|")), (strings.split("data", "|", 1), text.split("|", 1)),
        (strings.rsplit("data", "|", 1), text.rsplit("|", 1)), (strings.swapcase("data"), text.swapcase()),
        (strings.isupper("data"), text.isupper()), (strings.islower("data"), text.islower()), (strings.isalpha("data"), text.isalpha()),
        (strings.translate("data", strings.maketrans("AC", "xy", "G")), text.translate(str.maketrans("AC", "xy", "G"))),
    ]
    row = spark.createDataFrame([(text,)], "data string").select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(row) == [x for _, x in cases]


def test_slice_by_locations(spark):
    locs = "array(named_struct('start', 0L, 'stop', 10L, 'strand', '+'), named_struct('start', 15L, 'stop', 25L, 'strand', '+'), named_struct('start', 30L, 'stop', 40L, 'strand', '+'))"
    row = spark.createDataFrame([("ACGT" * 12,)], "data string").withColumn("locs", F.expr(locs))
    plain, filled, split = (row.select(joins.slice_locations(F.col("data"), F.col("locs"), **k).alias("x")).first()["x"] for k in ({}, {"filler": "-"}, {"splitter": "-----"}))
    assert len(plain) == 30 and len(filled) == 40 and split == filled
