"""Vectorised passes over letters against plain loops, with odd inputs and one very long sequence."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helixframe.functions import sequence
from helixframe.operators import counting, joins, match, orf, rows
from helixframe.operators import translate as tr
from helixframe.sources import fastaindex, io, parsers, writers


def table(spark, texts):
    return spark.createDataFrame([(k, f"s{k}", t) for k, t in enumerate(texts)], "ord long, id string, data string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    return ["", "A", "AT", "ATG", "ATGTAA", "AUGUAA", "NNN", *("".join(rng.choice(letters) for _ in range(rng.randint(3, 120))) for letters in ["ATG", "ACGT", "AUG", "ATGN", "ATTGGA"] for _ in range(40))]


def turned(text):
    pairs = dict(zip("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN", strict=True))
    if "U" in text:
        return "".join({"T": "U"}.get(pairs.get(c, c), pairs.get(c, c)) for c in reversed(text.replace("U", "T")))
    return "".join(pairs.get(c, c) for c in reversed(text))


def plain_frames(text, need_start, need_stop, every):
    """(frame, begin, end, has_stop) of the strand scanned, frame by frame, codon by codon."""
    out = []
    for strand in (1, -1):
        own = (text if strand > 0 else turned(text)).replace("U", "T")
        for phase in range(3):
            if len(own) <= phase:
                continue
            last = len(own) - (len(own) - phase) % 3
            begins, opened = [], phase
            for at in range(phase, last, 3):
                codon = own[at : at + 3]
                if codon == "ATG":
                    begins.append(at)
                if codon in ("TAG", "TAA", "TGA"):
                    out += [(phase if strand > 0 else -phase - 1, b, at + 3, True) for b in picked(begins, opened, at + 3, len(own), need_start, every)]
                    begins, opened = [], at + 3
            if not need_stop:
                out += [(phase if strand > 0 else -phase - 1, b, last, False) for b in picked(begins, opened, None, len(own), need_start, every) if b < last]
    return sorted(out)


def picked(begins, opened, end, size, need_start, every):
    if need_start == "never":
        return [opened]
    return begins if every and end is not None and end < size - 2 else begins[:1]


@pytest.mark.parametrize("need_start,need_stop,nested", [("always", True, "other"), ("always", False, "other"), ("always", True, "all"), ("never", True, "other"), ("never", False, "other")])
def test_frames_equal_a_plain_loop(spark, texts, need_start, need_stop, nested):
    found = orf.find_orfs(table(spark, texts), need_start=need_start, need_stop=need_stop, nested=nested, with_data=True).collect()
    own = {k: [] for k in range(len(texts))}
    for r in found:
        n = len(texts[r["seq_ord"]])
        begin, end = (r["start"], r["stop"]) if r["strand"] == "+" else (n - r["stop"], n - r["start"])
        own[r["seq_ord"]].append((r["rf"], begin, end, r["has_stop"]))
        cut = texts[r["seq_ord"]][r["start"] : r["stop"]]
        assert len(r["data"]) == len(cut) and (r["data"] == cut if r["strand"] == "+" else r["data"].replace("U", "T") == turned(cut.replace("U", "T")))
    for k, t in enumerate(texts):
        assert sorted(own[k]) == plain_frames(t, need_start, need_stop, nested == "all"), t


def test_counts_equal_plain_ones(spark, texts):
    more = [*texts, "éa", "aé", "ééé"]
    for k in (1, 3, 5, 9):
        want = Counter(t[i : i + k] for t in more for i in range(len(t) - k + 1))
        assert {r["word"]: r["count"] for r in counting.count_words(table(spark, more), k).collect()} == want
        each = {(r["id"], r["word"]): r["count"] for r in counting.word_table(table(spark, more), k).collect()}
        assert each == Counter((f"s{n}", t[i : i + k]) for n, t in enumerate(more) for i in range(len(t) - k + 1))
    assert counting.count_words(table(spark, []), 3).count() == 0


def test_translation_equals_the_loop(spark, texts):
    more = [*texts, "ATGNNNTAR", "ATGYTR", "atgTAA", "é" * 3, None]
    for complete, final_stop in ((True, None), (True, False), (False, True), (False, None)):
        found = {r["ord"]: r["data"] for r in tr.translate(table(spark, more), complete=complete, check_start=False, final_stop=final_stop, gap=None).collect()}
        for k, t in enumerate(more):
            if t is None or t.isascii():
                assert found[k] == (None if t is None else tr.translate_text(t, complete=complete, check_start=False, final_stop=final_stop, gap=None)), t


def test_a_chromosome_fits_a_task():
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"ACGT", dtype=np.uint8)[rng.integers(0, 4, 50_000_000)]
    found = orf.plain_orfs(letters, (0, 1, 2, -1, -2, -3), "always", True, "other", 300)
    assert len(found) == 6 and all((e - b >= 300).all() and ((e - b) % 3 == 0).all() for _, b, e, _, _ in found)


def test_matches_of_codons_equal_expressions(spark, texts):
    quick = match.match_codons(table(spark, texts), match.STOP_CODONS, "all").collect()
    slow = [(k, f, b, m) for k, t in enumerate(texts) for f, b, _, m in match.matches_of(t, turned(t), "|".join(match.STOP_CODONS), match.FRAMES, 0, None)]
    assert sorted((r["seq_ord"], r["rf"], r["raw_start"], r["match"]) for r in quick) == sorted(slow)


def test_lists_compare_nulls_and_arrays(spark):
    kind = "ord long, a string, b array<int>"
    x = spark.createDataFrame([(0, None, [1]), (1, "p", None), (2, "p", None), (3, "q", [2])], kind)
    y = spark.createDataFrame([(0, None, [1]), (1, "p", None), (2, "z", [])], kind)
    ords = lambda d: sorted(r["ord"] for r in d.collect())
    assert ords(rows.list_and(x, y)) == [0, 1, 2] and ords(rows.list_sub(x, y)) == [3] and ords(rows.remove_duplicates(x)) == [0, 1, 3]
    assert rows.list_xor(x, y).count() == 2 and rows.list_or(x, y).count() == 5


def test_one_missing_id_among_many(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("".join(f">r{k}\nACGT\n" for k in range(2500)))
    (tmp_path / "b.fasta").write_text(">extra\nGG\nTT\n")
    index = fastaindex.build_index(spark, str(tmp_path / "a.fasta"))
    assert fastaindex.fetch(index, [f"r{k}" for k in range(2000)]).count() == 2000
    with pytest.raises(KeyError, match="nobody"):
        fastaindex.fetch(index, [*(f"r{k}" for k in range(2000)), "nobody"])
    more = fastaindex.add_files(fastaindex.add_files(index, str(tmp_path / "b.fasta")), str(tmp_path / "b.fasta"))
    assert more.count() == 2501 and [r["fasta"] for r in fastaindex.fetch_fasta(more, ["extra", ("r7", 1, 3)]).orderBy("ord").collect()] == [">extra\nGGTT", ">r7:1-3\nCG"]


def test_a_long_name_is_cut_with_a_warning():
    with pytest.warns(UserWarning, match="is cut"):
        assert parsers.features_to_row([(1, 6, "overlong")], 8) == ".|ove|.."
    assert parsers.features_to_row([(0, 7, "mid")], 8) == "|-mid-|."


def test_hits_know_every_column(spark):
    head = "# BLASTN\n# Fields: query id, subject id, q. start, q. end, s. start, s. end, subject tax id, % query coverage per subject\n"
    hit = next(parsers.parse_blast(head + "a\tb\t1\t9\t11\t19\t77\t90.5\n"))
    assert hit["meta"]["staxid"] == "77" and hit["meta"]["qcovs"] == 90.5
    hit = next(parsers.parse_mmseqs("query\ttarget\tqstart\tqend\ttstart\ttend\tqorfstart\ttcov\na\tb\t1\t9\t11\t19\t4\t0.5\n"))
    assert hit["meta"]["qorfstart"] == 4 and hit["meta"]["tcov"] == 0.5
    gff = next(parsers.parse_gff("c\tx\tt\t1\t5\t.\t+\t.\tevalue=2e-7\n"))
    assert gff["evalue"] == 2e-7


def test_single_attach_and_concatenation(spark):
    s = table(spark, ["AC", "GT"])
    f = spark.createDataFrame([(5, "other", 3, 4), (6, None, 0, 1)], "ord long, seqid string, start long, stop long")
    one = joins.attach_one(s, f, 1)
    assert [(r["seq_ord"], r["ord"]) for r in one.orderBy("ord").collect()] == [(1, 5), (1, 6)]
    assert joins.attach_one(s, f.limit(1), 1, replace=False, old=one).count() == 3 and joins.attach_one(s, f.limit(1), 1, old=one).count() == 1
    assert [r["data"] for r in joins.concatenate(s, s.withColumn("data", sequence.reverse("data"))).orderBy("ord").collect()] == ["ACCA", "GTTG"]


def test_reading_without_numbers_needs_no_shuffle(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x\nACGT\n>y\nGG\n")
    found = io.read(spark, str(tmp_path / "a.fasta"), numbered=False)
    assert "Exchange" not in found._jdf.queryExecution().toString() and sorted(r["id"] for r in found.collect()) == ["x", "y"]
    assert [r["id"] for r in io.iterate(spark, str(tmp_path / "a.fasta"))] == ["x", "y"]
    assert writers.to_string(io.read(spark, str(tmp_path / "a.fasta")), "fasta") == ">x\nACGT\n>y\nGG\n"


def test_matches_of_codons_come_in_small_batches(spark):
    """A batch of texts, or one long text, gives its matches a bounded number at a time, backward words included."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("ACGT", 50), ("ACGU", 60), ("ACGUT", 70))]
    sets = pa.RecordBatch.from_pydict({"ord": [0, 1, 2], "id": ["a", "b", "c"]})
    offsets = np.cumsum([0, *map(len, texts)])
    places = np.array([rng.randrange(3) for _ in range(5 * match.RESULTS // 2)])
    begin = np.array([rng.randrange(48) for _ in places])
    frame = np.array([rng.choice([0, 1, 2, -1, -2, -3]) for _ in places])
    found = list(match._codon_batches(sets, np.frombuffer("".join(texts).encode(), np.uint8), offsets, [(places, places, frame, begin, begin)]))
    assert [b.num_rows for b in found] == [match.RESULTS, match.RESULTS, match.RESULTS // 2]
    got = [w for b in found for w in b["match"].to_pylist()]
    words = [texts[k][b : b + 3] for k, b in zip(places.tolist(), begin.tolist(), strict=True)]
    assert got == [turned(w) if f < 0 else w for w, f in zip(words, frame.tolist(), strict=True)]
    long = table(spark, ["TAA" * match.RESULTS * 2])
    assert match.match_codons(long, match.STOP_CODONS, 0).count() == 2 * match.RESULTS


def test_texts_are_read_few_at_a_time():
    read = []

    def batches():
        while True:
            read.append(1)
            yield pa.RecordBatch.from_pydict({"a": list(range(1000)), "b": ["x"] * 1000})

    rows_ = match.texts_of(batches())
    assert [next(rows_) for _ in range(1001)][-1] == (0, "x") and len(read) == 2
    first = next(match.batches_of(rows_, ["a", "b"], [pa.int64(), pa.string()]))
    assert first.num_rows == match.RESULTS and len(read) <= match.RESULTS // 1000 + 3
