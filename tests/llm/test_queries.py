"""The registered queries: with their SQL where there is some, with plain versions of their columns elsewhere."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import decontaminate, quality, queries, url_filter
from helixframe.llm.decontaminate import fewest_edits, word_hashes

from test_text_operators import plain_counts, plain_pii, plain_secrets  # isort: skip

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    rows = run(spark, name)
    assert sorted(rows[0]) == sorted(want.columns)
    names = sorted(rows[0])
    own = Counter(tuple(map(str, (r[n] for n in names))) for r in rows)
    assert own == Counter(tuple(map(str, (dict(zip(want.columns, r, strict=True))[n] for n in names))) for r in want.fetchall())


def test_op1(spark, documents):
    found = {r["doc_id"]: r["class_id"] for r in run(spark, "op1_order_minhash")}
    assert set(found) == set(documents) and all(found[c] == c <= i for i, c in found.items())
    same = defaultdict(set)
    for i, t in documents.items():
        same[" ".join((t or "").lower().split())].add(found[i])
    assert all(len(c) == 1 for c in same.values())


def test_op3(spark, documents):
    for r in run(spark, "op3_quality_rules"):
        n, chars, symbols, dup, repeat = plain_counts(documents[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def plain_posteriors(votes, rounds=50):
    """EM document by document, in plain numbers: the probability of being good of each."""
    good = [0.05 if v.count(quality.BAD) >= 2 else 0.7 if v.count(quality.BAD) == 1 else 0.98 for v in votes]
    last = None
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(good) + 2)
        table = []
        for k in range(len(votes[0])):
            sides = []
            for weight in ([1 - g for g in good], good):
                cast = [1 + sum(w for w, v in zip(weight, votes, strict=True) if v[k] == vote) for vote in (0, 1, 2)]
                sides.append([c / sum(cast) for c in cast])
            table.append(sides)
        good = []
        for v in votes:
            odds = prior / (1 - prior)
            for k, vote in enumerate(v):
                odds *= table[k][1][vote] / table[k][0][vote]
            good.append(odds / (1 + odds))
        if last and max(abs(a - b) for x, y in zip(table, last, strict=True) for s, t in zip(x, y, strict=True) for a, b in zip(s, t, strict=True)) < 1e-9:
            break
        last = table
    return good


def test_op3_verdicts(spark, documents):
    ids = sorted(documents)
    votes = [[r.vote(quality.count((documents[i] or "").encode())) for r in quality.RULES] for i in ids]
    want = dict(zip(ids, plain_posteriors(votes), strict=True))
    found = {r["doc_id"]: r for r in run(spark, "op3_quality_rules")}
    assert set(found) == set(ids) and all(abs(found[i]["quality"] - want[i]) < 1e-6 for i in ids)
    assert all(r["kept"] == (not r["base_failed"] and want[i] >= 0.5) for i, r in found.items())
    with pytest.raises(ValueError, match="rename"):
        quality.judge_quality(spark.createDataFrame([(1, "x")], "pattern long, text string"), id_col="pattern")


def test_one_name_for_both_ids(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    d = spark.createDataFrame([(1, f"so {words} it is", 5)], "n long, text string, edits int")
    b = spark.createDataFrame([(7, words), (7, words)], "n long, text string")
    found = decontaminate.find_passages(d, b, id_col="n", item_id="n").collect()
    assert [(r["n"], r["item_n"], r["edits"]) for r in found] == [(1, 7, 0)] * 2


def test_pipeline_of_an_empty_table_and_more_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("length", F.lit("clash")).withColumn("class_id", F.lit(1))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, name in ((docs.limit(0), "none"), (docs, "all")):
        here = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            here = stage(spark, here, str(tmp_path))
            assert here.columns == docs.columns
            here.write.parquet(f"{tmp_path}/{name}-{stage.__name__}")
            here = spark.read.parquet(f"{tmp_path}/{name}-{stage.__name__}")
        packed = corpus_pipeline.STAGES[-1][1](spark, here, str(tmp_path))
        assert (packed.count() == 0) == (name == "none")


def test_op4(spark, documents):
    for r in run(spark, "op4_secret_scan"):
        want = plain_secrets(documents[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r["spans"].split(","))


def test_op5(spark, documents):
    """Against the best passage of every item in every document."""
    items = {r["item_id"]: word_hashes(r["text"]).tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    words = {i: word_hashes(t).tolist() for i, t in documents.items()}
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in run(spark, "op5_decontamination")}
    for (i, k), edits in found.items():
        assert edits == fewest_edits(items[k], words[i])[0] <= 0.2 * len(items[k])
    want = {(i, k) for i, w in words.items() for k, item in items.items() if len(set(item) & set(w)) >= 0.5 * len(set(item)) and fewest_edits(item, w)[0] <= int(0.2 * len(item) + 1e-9)}
    assert len(want & set(found)) >= 0.98 * len(want) and want


def test_op7_rules_of_the_contract(spark, tmp_path):
    """Every rule's word as the contract has it; longest wins."""
    lines = [("http://a.com/en/1", "com/en/", "block"), ("http://example.com/en/71", "example.com/en/7", "allow"), ("http://a.net/de/1", "net/de/", "allow"), ("http://x.example.net/de/81?q", "example.net/de/8", "block"), ("http://example.net/de/7", "net/de/", "allow"), ("http://a.org/es/", "org/es/", "block"), ("http://a.net/en/", None, "allow")]
    spark.createDataFrame([(k, u) for k, (u, *_) in enumerate(lines)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.QUERIES["op7_url_filter"](spark, str(tmp_path)).collect()}
    assert [found[k] for k in range(len(lines))] == [(r, v) for _, r, v in lines]


def test_op7_method(spark):
    """Where no rule of the contract fits, the list decides."""
    lines = [("http://casino-win.example.net/", "block"), ("http://a.casino-win.example.net/x?y", "block"), ("http://casino-win.example.dev/", None), ("http://notcasino-win.example.net/", None), ("http://x.org/ads/1", "block"), ("http://x.org/ad", None), ("http://" + "a." * 5000 + "poker-club.example.org/" + "p" * 5000, "block")]
    pages = spark.createDataFrame([(k, u, "clash", 1) for k, (u, _) in enumerate(lines)], "page_id long, url string, rule string, host int")
    array = url_filter.build(url_filter.rule_table(spark, queries.URL_LIST))
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, array).collect()}
    assert [found[k] for k in range(len(lines))] == [v for _, v in lines]
    assert url_filter.judge_urls(pages.limit(0), array).count() == 0 and len(queries.URL_LIST) > 400


def test_op8(spark, documents):
    for r in run(spark, "op8_pii"):
        want = plain_pii(documents[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == (len(want.split(",")) if want else 0)


def test_op9(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in run(spark, "op9_token_counts"):
        text = documents[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
        assert r["over_limit"] == (r["n_tokens"] > 512)


def test_op10(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = run(spark, "op10_best_fit_packing")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(documents)
    for i, own in pieces.items():
        ids = [*library.encode(documents[i] or "", add_special_tokens=False).ids, 1]
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"] and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        assert sum(r["length"] for r in own) == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.01 * sum(r["length"] for r in rows) / 4096 + 1
