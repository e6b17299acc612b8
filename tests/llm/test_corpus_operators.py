"""Near duplicates, decontamination, chat trees, WARC and packing against plain versions, with odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import chat, decontaminate, near_dedup, packing, warc


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        what, at = rng.random(), rng.randrange(len(words) + 1)
        if what < 0.34:
            words.insert(at, rng.choice(vocabulary))
        elif what < 0.67 and len(words) > 1:
            words.pop(min(at, len(words) - 1))
        else:
            words[min(at, len(words) - 1)] = rng.choice(vocabulary)
    return words


def test_banded_alignment_equals_the_full_one():
    rng = random.Random(3)
    for _ in range(4000):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        b = edited(rng, a or ["a"], rng.randint(0, 10), "abcd") if rng.random() < 0.8 else [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        most, full = rng.randint(0, 12), plain_distance(a, b)
        assert near_dedup.edit_distance(a, b, most) == min(full, most + 1)


@pytest.fixture(scope="module")
def groups():
    """Texts and, for each, the number of its group: exact copies, near copies, a large group, unrelated ones."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = " ".join(rng.choice(vocabulary) for _ in range(12))
    texts, group = [], []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        copies = 40 if g == 0 else rng.choice([1, 1, 2, 4])
        for c in range(copies):
            words = base if c == 0 or rng.random() < 0.3 else edited(rng, base, max(1, len(base) // 40), vocabulary)
            texts.append(" ".join(words) + (f"\n{common}" if g % 3 == 0 else ""))
            group.append(g)
    return texts, group


def test_near_duplicate_classes(spark, groups):
    texts, group = groups
    rows = [(i, t, 1, 2) for i, t in enumerate([*texts, "", None, " "])]
    d = spark.createDataFrame(rows, "doc_id long, text string, id int, digest int")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(d).collect()}
    n = len(texts)
    assert len(found) == n + 3 and found[n] == found[n + 1] == found[n + 2] == n
    first = {}
    for i, g in enumerate(group):
        assert found[i] == first.setdefault(g, i)
    kept = near_dedup.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted([*first.values(), n])


def replaced(rng, words, edits, vocabulary):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = rng.choice(vocabulary)
    return words


def test_twins_in_large_buckets(spark):
    """Half of every text is one common passage, so its shingles' buckets hold all texts; only twins are alike enough."""
    rng = random.Random(23)
    vocabulary = [f"w{i}" for i in range(4000)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(700):
        own = [rng.choice(vocabulary) for _ in range(40)]
        texts += [common + own, common + replaced(rng, own, 12, vocabulary)]
    d = spark.createDataFrame([(i // 2 + 1000 * (i % 2), " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(d).collect()}
    assert sum(found[i] == found[i + 1000] == i for i in range(700)) >= 690 and len(set(found.values())) >= 700


def test_a_large_group_around_its_original(spark):
    """Copies are within reach of the original, hardly any of another copy: each must meet the original itself."""
    rng = random.Random(24)
    vocabulary = [f"w{i}" for i in range(4000)]
    original = [rng.choice(vocabulary) for _ in range(150)]
    texts = [replaced(rng, original, 20, vocabulary) for _ in range(600)]
    texts.insert(333, original)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [r["class_id"] for r in near_dedup.near_duplicate_classes(d).collect()]
    assert found.count(0) >= 595


def test_classes_equal_those_of_all_pairs(spark, groups):
    texts, _ = groups
    rng = random.Random(25)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [*texts, *(" ".join(replaced(rng, t.split(), len(t.split()) // 6, vocabulary)) for t in texts[60:160]), "one two three", "one two four", "", "x" * 3000]
    words = [t.lower().split() for t in texts]
    label = list(range(len(texts)))
    links = []
    for i in range(len(texts)):
        for j in range(i):
            most = int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)
            if abs(len(words[i]) - len(words[j])) <= most and near_dedup.edit_distance(words[i], words[j], most) <= most:
                links.append((i, j))
    for _ in range(len(texts)):
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(d).collect()}
    assert all(label[i] == label[c] for i, c in found.items())  # no class joins what no chain of links joins
    assert sum(found[i] == found[j] for i, j in links) >= 0.98 * len(links)
    members, pairs, _ = near_dedup.near_duplicates(d)
    assert {(r["b"], r["a"]) for r in pairs.collect()} <= set(links) and members.count() == len(texts)


def test_copies_without_their_original_are_linked(spark):
    """Most pairs of such copies lie just below the threshold, few above, and no member is a hub for the others."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(20000)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    texts = [" ".join(replaced(rng, base, 12, vocabulary)) for _ in range(250)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.similar(texts[i], texts[j], 0.8) is not None]
    assert 50 < len(links) < 0.05 * 250 * 249 / 2
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(d).collect()}
    assert sum(found[i] == found[j] for i, j in links) >= 0.95 * len(links)


def links_in_buckets(texts):
    """Pairs of texts that share a bucket of the operator and are alike enough, by plain loops."""
    known, members = near_dedup.WordHashes(), defaultdict(set)
    for i, t in enumerate(texts):
        words = np.array([known[w] for w in t.lower().split()], dtype=np.uint64)
        for tables, sample, width, first in ((24, 2, 5, 1), (16, 2, 2, 1001)):
            for key in near_dedup.order_min_hash(words, tables, sample, width, first).tolist():
                members[key].add(i)
    pairs = {(i, j) for own in members.values() for i in own for j in own if i < j}
    return [(i, j) for i, j in pairs if near_dedup.similar(texts[i], texts[j], 0.8) is not None], max(map(len, members.values()))


def passages(seed):
    """300 texts that share 36 words; of the other 24, two texts have every second one in common: a link, just."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    common, *own = ([rng.choice(vocabulary) for _ in range(n)] for n in (36, *[24] * 300))
    own[200][::2] = own[10][::2]
    return [" ".join(common + words) for words in own]


@pytest.mark.parametrize("size", [1024, 16])
def test_every_link_inside_a_bucket_is_found(spark, monkeypatch, size):
    """Against plain loops: the only link stands in buckets of hundreds of texts that nothing else links; in one block
    and in many."""
    monkeypatch.setattr(near_dedup, "BLOCK", size)
    texts = passages(33)
    links, largest = links_in_buckets(texts)
    assert links == [(10, 200)] and largest > 200
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(d).collect()}
    assert {i: c for i, c in found.items() if i != c} == {200: 10}


def test_wider_pairs_are_all_within_the_width(spark, monkeypatch):
    """Against plain loops: a hot bucket over many blocks, borders of blocks and of ranges, classes, lengths."""
    rng = random.Random(6)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PAIRS_AT_ONCE", 50)
    sizes = [150, 1, 7, 40, 2]
    rows = [(b, i, rng.choice((10, 12, 20))) for b, size in enumerate(sizes) for i in rng.sample(range(200), size)]
    cut = (0, 40, 41, 170, len(rows))  # ranges as they stand before numbers go on
    numbered = [(*r, (k << 33) + at - begin) for k, (begin, end) in enumerate(zip(cut, cut[1:])) for at, r in enumerate(rows) if begin <= at < end]
    shared = near_dedup.consecutive(spark.createDataFrame(numbered, "bucket long, id long, n_words int, number long"))
    assert sorted(r["number"] for r in shared.collect()) == list(range(len(rows)))
    label = {i: i % 3 for i in range(0, 200, 2)}  # the others are classes of their own
    labels = spark.createDataFrame([(i, label.get(i, i)) for i in range(200)], "id long, label long")
    going = shared.filter("bucket in (0, 1, 3)").join(labels, "id")
    bag = {i: [rng.randrange(3) for _ in range(near_dedup.BAG)] if i % 5 == 0 else [0] * near_dedup.BAG for i in range(200)}
    texts = spark.createDataFrame([(i, bytearray(b)) for i, b in bag.items()], "id long, bag binary")
    for width in (4, 16):
        wanted = set()
        for at, (b, i, n) in enumerate(rows):
            for b2, i2, n2 in rows[max(0, at - width) : at]:
                if b == b2 and b in (0, 1, 3) and label.get(i, i) != label.get(i2, i2) and min(n, n2) >= 0.8 * max(n, n2) and bag[i] == bag[i2]:
                    wanted.add((min(i, i2), max(i, i2)))
        found = near_dedup.wider_pairs(going, texts, width, 0.8).collect()
        assert len(found) == len(wanted) and {(r["a"], r["b"]) for r in found} == wanted


def test_pairs_at_the_threshold_are_found(spark):
    rng = random.Random(29)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(300):
        base = [rng.choice(vocabulary) for _ in range((5, 9, 14, 40, 120, 200)[k % 6])]
        copy = list(base)
        for at in rng.sample(range(len(base)), len(base) // 5):
            copy[at] = rng.choice(vocabulary)
        assert near_dedup.similar(" ".join(base), " ".join(copy), 0.8)
        texts += [base, copy]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(d).collect()}
    together = [found[2 * k] == found[2 * k + 1] for k in range(300)]
    assert all(sum(together[k::6]) >= 46 for k in range(6))


def test_repeated_rows_and_missing_ids(spark):
    text = "one two three four five six seven"
    d = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, "x")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in near_dedup.drop_near_duplicates(d).collect()))) == ["1", "None", "None"]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicate_classes(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (99, 101)], "a long, b long")
    found = {r["id"]: r["label"] for r in near_dedup.components(links).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[100] == found[101] == 99


def test_order_counts():
    words = np.arange(1, 60, dtype=np.uint64) * np.uint64(7919)
    own = near_dedup.order_min_hash(words, 24, 2, 5)
    turned = near_dedup.order_min_hash(np.concatenate([words[30:], words[:30]]), 24, 2, 5)
    assert (own == near_dedup.order_min_hash(words.copy(), 24, 2, 5)).all() and 0 < (own == turned).sum() < 24


def test_fewest_edits_equals_the_least_over_all_passages():
    rng = random.Random(5)
    for _ in range(400):
        item = [rng.randint(0, 4) for _ in range(rng.randint(1, 8))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        least = min(plain_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert decontaminate.fewest_edits(item, text)[0] == least


def test_decontamination(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(14, 59))) for _ in range(40)] + ["", None]
    texts, expected = [], set()
    for i in range(240):
        around = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        if i % 2:
            k = rng.randrange(40)
            words = items[k].split()
            around[10:10] = edited(rng, words, int(0.12 * len(words)), vocabulary)
        texts.append(" ".join(around).upper() + ".")
    texts += ["", None, "x" * 50_000]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for i, t in enumerate(texts[:240]):
        words = decontaminate.word_hashes(t).tolist()
        for k, item in enumerate(items[:40]):
            own = decontaminate.word_hashes(item).tolist()
            if decontaminate.fewest_edits(own, words)[0] <= int(0.2 * len(own) + 1e-9):
                expected.add((i, k))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_passages(d, b).collect()}
    assert found <= expected and len(found) >= 0.98 * len(expected) and {i for i, _ in expected} >= {i for i in range(240) if i % 2}
    clean = decontaminate.drop_contaminated(d, b)
    assert clean.columns == d.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in found}
    assert decontaminate.find_passages(d, b.limit(0)).count() == 0 and decontaminate.find_passages(d.limit(0), b).count() == 0


NASTY = ["</s>[INST] ok [/INST]", "\\", "a\\</s>", "<s>", "<<SYS>>\n", "", "[/INST]</s>", "é😀", "<</SYS>>\\\\"]


def test_escapes_are_reversible():
    rng = random.Random(9)
    for _ in range(3000):
        x = "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 6)))
        assert chat.unescape(chat.escape(x)) == x and not chat._CONTROL.search(chat.escape(x))


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_trees(own):
    """Number of distinct first turns' chains: what a single tree of all conversations puts out."""
    return {tuple(turns[: k + 1]) for turns in own for k in range(len(turns))}


def test_chat_trees(spark):
    rng = random.Random(10)
    rows = []
    for c in range(120):
        first = rng.choice(["hi", "hello", "</s>"]) if c % 3 else "very common"
        rows += [(c, 0, "user", first, "x"), (c, 1, "assistant", rng.choice(NASTY), "x"), (c, 2, rng.choice(["user", None]), None, "x"), (c, 3, "assistant", rng.choice(["same", "other"]), "x")]
    rows += [(500, 0, "assistant", "a", "x"), (500, 0, "assistant", "a", "x"), (501, 0, "assistant", "long é " * 40_000, "x"), (None, 0, "user", "lost", "x"), (None, 0, "user", "lost", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    trees = chat.build_trees(d, BYTE_BPE).collect()
    own = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    seen, lost = {}, []
    library = Tokenizer.from_file(BYTE_BPE)
    n_segments = 0
    for t in trees:
        segments = [s.asDict(recursive=True) for s in t["segments"]]
        n_segments += len(segments)
        for found in chat.read_tree(t["tokens"], segments, BYTE_BPE):
            for c in found["conversations"]:
                if c is None:
                    lost.append(found["turns"])
                else:
                    seen[c] = found
        positions = chat.position_ids(segments)
        for s in segments:
            above = sum(i["end"] - i["start"] for i in s["attends"])
            assert positions[s["start"]] == above == s["position"]
            if s["parent"] >= 0:
                assert chat.may_attend(segments, s["start"], segments[s["parent"]]["start"])
        line = library.decode(t["tokens"], skip_special_tokens=False)
        assert "".join(chat.format_turn(*x)[0] for x in chat.parse_turns(line)) == line
    assert set(seen) == set(own) and lost == [[("user", "lost")]] * 2
    for c, turns in own.items():
        assert seen[c]["turns"] == [x[1:] for x in sorted(turns)]
        assert seen[c]["loss"] == "".join(x for _, r, x in sorted(turns) if r == "assistant")
    distinct = plain_trees([x[1:] for x in sorted(turns)] for turns in own.values())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(distinct) <= n_segments - 1 <= len(distinct) + 1 + 4 * parts  # a path begins anew at a border of ranges
    read = {r["conv_id"]: r for r in chat.read_back(chat.build_trees(d, BYTE_BPE), BYTE_BPE).collect()}
    joined = "".join(f"{r}\n{x}\n" for _, r, x in sorted(own[500]))
    assert read[500]["turns_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and read[500]["n_turns"] == 2
    assert chat.build_trees(d.limit(0), BYTE_BPE).count() == 0


def test_shared_tokens_are_put_out_once_a_tree(spark):
    """5000 conversations with one first turn: it is repeated only where a row is full or a range ends."""
    first = "the same system prompt " * 20
    rows = [(c, t, r, x) for c in range(5000) for t, r, x in ((0, "user", first), (1, "assistant", f"answer {c}"))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees = chat.build_trees(d, BYTE_BPE, most_conversations=1500).collect()
    ends = [sum(len(s["conversations"]) for s in t["segments"]) for t in trees]
    roots = sum(s["parent"] < 0 for t in trees for s in t["segments"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(ends) == 5000 and max(ends) <= 1500 and roots == len(trees) <= parts + 5000 // 1500
    assert len(chat.build_trees(d, BYTE_BPE, most_tokens=2000).collect()) > len(trees)


def test_warc_round_trip(spark, tmp_path):
    long, other = "é" * 700, "b" * 1000
    pages = [(1, "http://a.com/x", long), (2, "http://b.com/", long), (3, None, long), (4, "http://a.com/x", "short"), (5, "http://c.org/?q=1#f", "short"), (6, "x", None), (7, "http://a.com/y", other), (7, "http://a.com/y", other), (8, "http://é.com/ü?\n", "long " * 400_000), (None, "http://a.com/x", "no id")]
    rows = [(*p, "clash", 1) for p in pages]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, key string, refers_to int")
    folder, directory = warc.archive(d, f"file://{tmp_path}/w")
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_all(d, directory).collect()]
    sha = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    expected = [(i, len((h or "").encode()), sha(h), "revisit" if i in (1, 2) else "response", 3 if i in (1, 2) else None) for i, _, h in pages]
    assert sorted(found, key=str) == sorted(expected, key=str)
    index = warc.Index(directory)
    assert [(f["place"]["id"], f["fields"]["WARC-Type"]) for f in index.lookup("http://a.com/x")] == [(None, "response"), (1, "revisit"), (4, "response")]
    assert index.lookup("http://a.com/x")[2]["payload"] == b"short" and index.lookup("http://nowhere/") == []
    assert index.lookup("http://c.org/?q=1")[0]["place"]["id"] == 5
    _, none = warc.archive(d.limit(0), f"file://{tmp_path}/none")
    assert warc.read_all(d.limit(0), none).count() == 0 and warc.Index(none).lookup("x") == []


def test_lookups_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "DIRECTORY_ROWS", 2)
    d = spark.createDataFrame([(i, f"http://h{i % 7}.com/{i // 2}" if i % 3 else "http://hot.com/", f"p{i}") for i in range(2400)], "page_id long, url string, html string")
    folder, directory = warc.archive(d, f"file://{tmp_path}/w")
    index = warc.Index(directory)
    assert index.directory.rows >= 8 and len({index.directory.first(k) for k in range(index.directory.rows)}) == index.directory.rows
    for i in (1, 13, 451, 899):
        assert i in [f["place"]["id"] for f in index.lookup(f"http://h{i % 7}.com/{i // 2}")]
    assert [f["place"]["id"] for f in index.lookup("http://hot.com/")] == list(range(0, 2400, 3))
    want = warc.order(warc.surt("http://hot.com/"), 999)
    assert [p["id"] for p in index.places(want, want)] == [999]


def contents(plan, histogram):
    """What the plan puts in each sequence: [(offset, length)]."""
    where = defaultdict(list)
    starts = defaultdict(list)
    for n, lo in zip(plan.length, plan.lo, strict=True):
        starts[n].append(lo)
    for k, n in enumerate(plan.length):
        end = min((x for x in starts[n] if x > plan.lo[k]), default=histogram[n])
        for r in range(plan.lo[k], end):
            seq, i = divmod(r - plan.lo[k], plan.copies[k])
            where[plan.first[k] + seq].append((plan.offset[k] + i * n, n))
    return where


def packed_piece_by_piece(histogram, cap):
    """The same choice for one piece after another: (tokens, documents, attention) of all sequences, sorted."""
    scale = np.array([cap.tokens, cap.documents, cap.attention], dtype=float)
    weights = np.array(cap.weights)
    sequences = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        ask = np.array([n, 1, n * n])
        fits = [k for k, used in enumerate(sequences) if (used + ask <= scale).all()]
        if not fits:
            sequences.append(ask)
            continue
        left = (scale - np.array([sequences[k] for k in fits])) / scale
        score = ((left - ask / scale) ** 2) @ weights if cap.score == "norm" else -(left * (ask / scale)) @ weights
        best = fits[int(np.argmin(score))]
        sequences[best] = sequences[best] + ask
    return sorted(map(tuple, np.array(sequences).tolist()))


# odd weights, so that different sequences never score the same
CAPACITIES = [packing.Capacity(64, d, a, w, score) for score in ("norm", "dot") for d, a, w in ((64, 4096, (1, 0.1234567, 0.0987654)), (5, 2000, (1, 0.3123, 0.2871)), (3, 4096, (1, 1.0123, 0.9871)))]


@pytest.mark.parametrize("cap", CAPACITIES)
@pytest.mark.parametrize("seed", [12, 13])
def test_plans_hold_every_constraint_and_equal_the_choice_piece_by_piece(cap, seed):
    rng = random.Random(seed)
    top = min(64, int(cap.attention**0.5))
    histogram = {n: rng.randint(1, 60 if seed == 12 else 3) for n in range(1, top + 1) if rng.random() < 0.8}
    plan = packing.plan_packing(histogram, cap)
    where = contents(plan, histogram)
    assert sum(map(len, where.values())) == sum(histogram.values()) and len(where) == plan.sequences
    for pieces in where.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= cap.tokens and len(pieces) <= cap.documents and sum(n * n for _, n in pieces) <= cap.attention
    found = sorted((sum(n for _, n in p), len(p), sum(n * n for _, n in p)) for p in where.values())
    plain = packed_piece_by_piece(histogram, cap)
    if cap.score == "norm":
        assert found == plain
    else:  # equal scores of different sequences may be taken in another order
        assert abs(len(found) - len(plain)) <= 0.01 * len(plain)


def test_each_constraint_and_each_weight_changes_the_plan():
    def with_the_last(histogram, **how):
        """The sequence that takes the piece of 10."""
        where = contents(packing.plan_packing(histogram, packing.Capacity(64, **({"documents": 64, "attention": 4096} | how))), histogram)
        return sorted(n for _, n in next(p for p in where.values() if 10 in [n for _, n in p]))

    # 13 tokens are left beside one document, or 14 beside two
    one = {51: 1, 25: 2, 10: 1}
    assert with_the_last(one, weights=(1, 0, 0)) == [10, 51]
    assert with_the_last(one, weights=(0.1, 3, 0)) == [10, 25, 25] == with_the_last(one, weights=(1, 0, 0), score="dot")
    assert with_the_last(one, weights=(1, 0, 0), attention=2650) == [10, 25, 25]
    # 14 tokens are left beside one document (and much attention), or 13 beside two
    two = {50: 1, 26: 1, 25: 1, 10: 1}
    assert with_the_last(two, weights=(1, 0, 0)) == [10, 25, 26]
    assert with_the_last(two, weights=(0.1, 0, 3)) == [10, 50] == with_the_last(two, weights=(1, 0, 0), documents=2)


def test_packing_of_documents(spark):
    rng = random.Random(13)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(rng.choice(["Alpha", "beta,", "don't", "İ", "12", "ΑΣ", "naïve", "<|endoftext|>", "x\x1cy"]) for _ in range(rng.randint(0, 300))) for _ in range(80)] + ["", None, "w " * 9000, "same", "same"]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, k * 4096, len(ids[k * 4096 : (k + 1) * 4096])) for k in range(-(-len(ids) // 4096))]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.pack_documents(d.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    kept = {r["doc_id"] for r in rows}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    assert kept and not any(labels.get(i) == 0 for i in kept)
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert len({classes[i] for i in kept}) == len(kept)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert not any(item in texts[i] for i in kept for item in items)


def test_pipeline_drops_the_only_near_copy_of_a_large_bucket(spark):
    import corpus_pipeline

    d = spark.createDataFrame(list(enumerate(passages(33))), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, d, "").select("doc_id").collect()} == set(range(300)) - {200}


def test_pipeline_compares_every_text_of_a_repeated_id(spark):
    """Ids that stand in two rows with different texts: no text's links are lost, and no text goes with its id's other one."""
    import corpus_pipeline

    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    other, text = ([[rng.choice(vocabulary) for _ in range(80)] for _ in range(20)] for _ in range(2))
    rows = [(100 + k, " ".join(words)) for k in range(20) for words in (other[k], text[k])]
    rows += [(200 + k, " ".join(replaced(rng, text[k], 1, vocabulary))) for k in range(20)]
    rows += [(1, rows[0][1]), (7, None), (7, "")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _ROW string").repartition(4)
    found = near_dedup.near_duplicate_classes(d)
    assert found.columns == ["doc_id", "class_id"]
    found = sorted((r["doc_id"], r["class_id"]) for r in found.collect())
    assert found == sorted([(1, 1), (7, 7), (7, 7), (100, 1), (100, 100), (200, 100)] + [(i + k, 100 + k) for k in range(1, 20) for i in (100, 100, 200)])
    kept = corpus_pipeline.near_dedup(spark, d, "")
    assert kept.columns == d.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted((i, t or "") for i, t in kept) == sorted([(1, rows[0][1]), (7, "")] + rows[1:40])
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(d)
