"""Near-duplicate classes by Order MinHash and banded alignment.

Sketch. A text is its lower-case words between white space. Its 5-word shingles are labelled with their occurrence
number, so repeats count. For each of `tables` random orders, the `sample` smallest labelled shingles are taken and
kept in the order in which they stand in the text; that ordered sample, hashed, is the text's bucket in that table.
Two texts share a bucket only if they share shingles in the same order, so the chance rises with edit similarity.
Edits of a fifth of the words leave few 5-word shingles, so `fine` more tables take 2 of the 2-word shingles, and
`short` more take 1 of them for texts of at most SHORT_WORDS words.

Candidates are all pairs of texts of a bucket, whatever its size. First every member is compared with its bucket's hub:
the member that shares most buckets of all, as the text does that a group of copies was made from. That is linear in
the bucket, finishes buckets of two, and puts most copies into one class. Then the rest, for every bucket of three or
more that holds several classes: each pair of members of different classes is compared where it stands, without a row
for the pair. The bucket's members are dealt out by blocks, each pair of blocks to one task, so none meets in a task
as a whole. A pass over counts of words finds the members that may have a link there at all; a second one, with
the texts of those alone, aligns. A pair that shares several buckets is aligned in the first of them.

Links. Texts with equal words are one text first. Candidates whose counts of words forbid a link go; the rest are
verified by alignment of words within a band that allows (1 - threshold) of the longer text in edits. Pairs that a task
has found in one class by then are left out, so links are those that join classes, at most a few for each member.

Classes. Connected components of the links, by hooking to the smallest id around and redrawing the links between
what is left; nothing but counts reaches the driver.

Defined results: null and empty texts (and those of white space) are equal texts and form one class; a text of fewer
than 5 words is one shingle (and one without white space is one word, which is alike to its equals only); repeated
rows share a class; rows that share an id but not a text are compared each by its own text, so they may be in several
classes (of the same name, if the id is the smallest of both), and one row of each class stays; rows without an id get
no class and are never dropped; an empty table gives an empty result; other columns pass through drop_near_duplicates
untouched.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, materialise, small_batches

#: Distinct words whose hash a task remembers; when full the memory starts anew, so it is bounded.
CACHE_ENTRIES = 200_000
#: Counts of words by six bits of their hash that go with a text.
BAG = 64
#: Words of a text that also has tables of single pairs of words: one edit may leave it no two in common.
SHORT_WORDS = 12
#: Members of a block of texts; blocks of counts of words, which are shorter, hold COUNTS times as many. A task takes
#: two blocks of a bucket at a time, and every two blocks meet.
BLOCK, COUNTS = 1024, 8
#: Pairs of a block that are put out at once.
PAIRS_AT_ONCE = 100_000
_U = np.uint64


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles, the same labelled with their occurrence number and scrambled)."""
    n = len(words)
    k = max(1, min(width, n))
    if not n:
        words, n = np.zeros(1, dtype=_U), 1
    gram = words[: n - k + 1].copy()
    for j in range(1, k):
        gram *= _U(0x9E3779B97F4A7C15)
        gram += words[j : n - k + 1 + j]
    gram = mix(gram)
    order = np.argsort(gram, kind="stable")
    ranked = gram[order]
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    if not len(again):
        return gram, gram
    place = np.arange(len(gram))
    fresh = np.ones(len(gram), dtype=bool)
    fresh[again] = False
    occurrence = np.empty(len(gram), dtype=_U)
    occurrence[order] = (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(_U)
    return gram, np.where(occurrence == 0, gram, mix(gram + occurrence * _U(0xD6E8FEB86659FD93)))


@functools.lru_cache(maxsize=16)
def _seeds(first: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(first, first + tables, dtype=_U) * _U(0xA0761D6478BD642F))
    return seeds, mix(seeds) | _U(1)


def smallest(gram: np.ndarray, label: np.ndarray, tables: int, sample: int, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each table: the hash of its sample of shingles in text order, and the label of the smallest shingle."""
    seeds, factors = _seeds(first, tables)
    values = label[None, :] ^ seeds[:, None]
    values *= factors[:, None]  # labels are well mixed: one product orders them anew for each table
    rows = np.arange(tables)
    picked = np.empty((tables, min(sample, len(gram))), dtype=np.int64)
    for j in range(picked.shape[1]):
        picked[:, j] = values.argmin(axis=1)
        values[rows, picked[:, j]] = _U(0xFFFFFFFFFFFFFFFF)
    lowest = label[picked[:, 0]]
    picked.sort(axis=1)
    key = seeds.copy()
    for j in range(picked.shape[1]):
        key = mix(key * _U(0x9E3779B97F4A7C15) + gram[picked[:, j]])
    return key, lowest


def order_min_hash(words: np.ndarray, tables: int, sample: int, width: int, first: int = 1) -> np.ndarray:
    """One 64-bit bucket for each table, from the hashes of a text's words; first is the number of the first table."""
    return smallest(*shingles(words, width), tables, sample, first)[0]


def buckets_of(words: np.ndarray, tables: int, sample: int, width: int, fine: int, short: int) -> np.ndarray:
    """The buckets of a text, of wide shingles, of pairs of words (fine) and, if it is short, of single pairs (short)."""
    found = [order_min_hash(words, tables, sample, width)]
    if fine:
        found.append(order_min_hash(words, fine, 2, 2, 1001))
    if short and 0 < len(words) <= SHORT_WORDS:
        found.append(order_min_hash(words, short, 1, 2, 2001))
    return np.concatenate(found)


def sketch(df: DataFrame, tables: int, sample: int, width: int, fine: int, short: int, id_col: str, text_col: str) -> DataFrame:
    """(id, digest of the words, n_words, bag, buckets): one narrow pass."""
    kind = df.schema[id_col].dataType.simpleString()
    known = WordHashes()  # each task gets its own, which goes with the task

    def one(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"digest": [], "n_words": [], "bag": [], "buckets": []}
        for text in batch.column(1):
            words = (text.as_py() or "").lower().split()
            hashes = np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words))
            out["digest"].append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")))
            out["n_words"].append(len(words))
            bag = np.bincount((hashes >> _U(58)).astype(np.int64), minlength=BAG)
            out["bag"].append(np.minimum(bag, 255).astype(np.uint8).tobytes())
            out["buckets"].append(buckets_of(hashes, tables, sample, width, fine, short).view(np.int64))
        return out | {"id": batch.column(0)}

    return map_arrow(df.select(id_col, text_col), one, f"id {kind}, digest binary, n_words int, bag binary, buckets array<long>")


def edit_distance(a: list, b: list, most: int) -> int:
    """Edits between two sequences, or most + 1 if there are more: alignment within a band of 2 * most + 1 diagonals.

    The band's vertical differences are kept in two bit vectors that slide down the diagonal, so a column costs a few
    operations on integers of the band's width.
    """
    if len(a) > len(b):
        a, b = b, a
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n:
        return m
    most_here = min(most, m)
    width = 2 * most_here + 1
    full = (1 << width) - 1
    bottom = 1 << (width - 1)
    # the band's lowest row sits at bit width - 1; rows above the matrix hold no letters
    letters: dict = {}
    for i, x in enumerate(a):
        letters[x] = letters.get(x, 0) | 1 << i
    up = full ^ ((1 << most_here) - 1)  # rows below row 0 rise by one each in column 0
    down = 0
    score = min(most_here, n)  # of the band's lowest row in column 0, or of the last row if the band reaches it
    turn = m - max(0, n - most_here)  # columns from which the last row is inside the band
    for j, x in enumerate(b):
        at = letters.get(x, 0)
        shift = j - most_here
        match = (at >> shift if shift >= 0 else at << -shift) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up = down | full & ~(diagonal | up)
        right_down = diagonal & up
        last = j + most_here  # matrix row (from 0) of the band's lowest row
        if last < n:
            score += not diagonal & bottom
        else:
            row = 1 << (width - 1 - (last - n + 1))
            score += bool(right_up & row) - bool(right_down & row)
        if score - min(turn, m - 1 - j) > most_here:  # only along the last row can the score still fall
            return most + 1
        slid = diagonal >> 1
        up = (right_down | full & ~(slid | right_up)) & full
        down = slid & right_up
    return score if score <= most_here else most + 1


def similar(one: str, two: str, threshold: float) -> float | None:
    """Edit similarity 1 - edits / words of the longer text, or None below the threshold."""
    a, b = one.lower().split(), two.lower().split()
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    most = int((1 - threshold) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return None
    bag = Counter(a)
    bag.subtract(b)
    extra = sum(v for v in bag.values() if v > 0)
    if max(extra, extra + len(b) - len(a)) > most:  # words of one text that the other lacks are edits at least
        return None
    edits = edit_distance(a, b, most)
    return None if edits > most else 1 - edits / longest


def shared_buckets(texts: DataFrame) -> DataFrame:
    """(bucket, id, n_words, number) of all texts (id, n_words, buckets) in each bucket that they share; number tells
    the order by bucket and length, and the range in its bits from 33 on.

    One shuffle by ranges of (bucket, n_words, id) and one pass over each range, which keeps one row. The rows at a border
    of ranges are put out too, as they may share their bucket with those of another range.
    """
    kind = texts.schema["id"].dataType.simpleString()
    member = texts.select(F.explode("buckets").alias("bucket"), "id", "n_words")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = member.repartitionByRange(parts, "bucket", "n_words", "id").sortWithinPartitions("bucket", "n_words", "id")
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, equal = None, True  # the last row, and whether it shares its bucket with the one before (or may)
        for batch in batches:
            if batch.num_rows:
                own = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
                bucket = own.column(0).to_numpy()
                same = np.concatenate([[equal], bucket[1:] == bucket[:-1]])
                yield own.take(pa.array(np.flatnonzero(same[:-1] | same[1:])))
                kept, equal = own.slice(own.num_rows - 1), bool(same[-1])
        if kept is not None:
            yield kept

    return ordered.mapInArrow(run, f"bucket long, id {kind}, n_words int").withColumn("number", F.monotonically_increasing_id())


def consecutive(shared: DataFrame) -> DataFrame:
    """shared with numbers that go on from one range to the next: one count a range comes to the driver."""
    bits = F.shiftright("number", 33)
    counts = sorted((r["range"], r["count"]) for r in shared.groupBy(bits.alias("range")).count().collect())
    starts, so_far = [], 0
    for part, count in counts:
        starts.append((part, so_far))
        so_far += count
    offsets = F.broadcast(shared.sparkSession.createDataFrame(starts, "range long, start long"))
    inner = F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    return shared.withColumn("range", bits).join(offsets, "range").withColumn("number", F.col("start") + inner).drop("range", "start")


def mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, n_words, label, place, members) of the buckets of three members or more that hold more than one class:
    place is a member's number in the bucket. Of buckets of two, the hub has met the other."""
    member = shared.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    bucket = member.groupBy("bucket").agg(F.count("*").alias("members"), F.min("number").alias("start"), F.min("label").alias("low"), F.max("label").alias("high"))
    going = bucket.filter("members > 2 and low <> high").select("bucket", "members", "start")
    return member.join(going, "bucket").select("bucket", "id", "n_words", "label", (F.col("number") - F.col("start")).alias("place"), "members")


def in_blocks(member: DataFrame, size: int) -> DataFrame:
    """member (bucket, place, members, ...) with own, its block of size places, once for each block of its bucket: the
    rows of the same (bucket, one, two) are two blocks that meet, or one alone if one = two. Sorted by them."""
    blocks = F.floor((F.col("members") - 1) / size).cast("int")
    own = F.floor(F.col("place") / size).cast("int")
    dealt = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks)))
    dealt = dealt.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("other")
    parts = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "place")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of (bucket, one, two) from sorted rows, and where each group begins, and the end."""
    waiting: list[pa.RecordBatch] = []

    def starts(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        keys = [rows.column(name).to_numpy() for name in ("bucket", "one", "two")]
        new = np.zeros(max(0, rows.num_rows - 1), dtype=bool)
        for key in keys:
            new |= key[1:] != key[:-1]
        return np.flatnonzero(new) + 1

    def put_out() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        return rows, np.concatenate([[0], starts(rows), [rows.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting:  # where does the last group go on to?
            last = waiting[-1].slice(waiting[-1].num_rows - 1)
            edge = starts(pa.Table.from_batches([last, batch]))
            edges = edge - 1
        else:
            edges = starts(batch)
        if len(edges):
            if edges[-1]:
                waiting.append(batch.slice(0, edges[-1]))
            yield put_out()
            waiting = [batch.slice(edges[-1])]
        else:
            waiting.append(batch)
    if waiting:
        yield put_out()


def in_reach(going: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The rows of going (as mixed gives them) that, by lengths and counts of words (bags: id, bag), may have a link to
    a member of their bucket in another class."""
    kind = going.schema["id"].dataType.simpleString()
    member = going.hint("merge").join(bags.select("id", "bag"), "id")
    small_batches(going.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches):
            words, own, alone = rows.column("n_words").to_numpy(), rows.column("own").to_numpy(), (rows.column("one").to_numpy() == rows.column("two").to_numpy())
            label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            bag = bags_of(rows.column("bag"))
            last = np.repeat(starts[1:], np.diff(starts)) - 1  # of each row's group
            reached = np.zeros(rows.num_rows, dtype=bool)
            at, d = np.arange(rows.num_rows), 0
            while len(at):
                d += 1
                at = at[at + d <= last[at]]
                at = at[words[at] >= threshold * words[at + d] - 1e-9]  # in order of length: those further on are longer
                pair = at[(label[at] != label[at + d]) & (alone[at] | (own[at] != own[at + d])) & ~(reached[at] & reached[at + d])]
                for cut in range(0, len(pair), PAIRS_AT_ONCE):
                    x = pair[cut : cut + PAIRS_AT_ONCE]
                    x = x[least_edits(bag[x], bag[x + d]) <= edits_allowed(words[x], words[x + d], threshold)]
                    reached[x] = reached[x + d] = True
            yield from rows.select(["bucket", "id", "label", "place", "members"]).take(pa.array(np.flatnonzero(reached))).to_batches()

    dealt = in_blocks(member, COUNTS * BLOCK).select("bucket", "one", "two", "own", "place", "members", "id", "n_words", "label", "bag")
    return dealt.mapInArrow(run, f"bucket long, id {kind}, label {kind}, place long, members long").distinct()


def joining_links(reached: DataFrame, texts: DataFrame, df: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b, similarity) between different classes in the buckets of reached (as in_reach gives it): so many that
    their classes are those of all such links. texts: id, buckets."""
    kind = reached.schema["id"].dataType.simpleString()
    wanted = reached.select("id").distinct()
    text = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(wanted.hint("merge"), "id", "left_semi")
    member = reached.hint("merge").join(text.hint("merge").join(texts.select("id", "buckets"), "id"), "id")
    schema = f"a {kind}, b {kind}, similarity double"
    fields = arrow_schema(schema)
    small_batches(reached.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches):
            found = [link for begin, end in zip(starts[:-1], starts[1:]) for link in group_links(rows.slice(begin, end - begin), threshold)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), fields)], schema=fields)

    dealt = in_blocks(member, BLOCK).select("bucket", "one", "two", "own", "place", "id", "label", "text", "buckets")
    return dealt.mapInArrow(run, schema)


def group_links(rows: pa.Table, threshold: float) -> list[tuple]:
    """The links (a, b, similarity) of two blocks of a bucket that join classes; pairs of one block alone if it is alone.

    Pairs that also share a bucket of an earlier table are compared there.
    """
    ids, own = rows.column("id").to_pylist(), rows.column("own").to_numpy()
    alone, bucket = rows.column("one")[0] == rows.column("two")[0], rows.column("bucket")[0].as_py()
    number: dict[str, int] = {}
    words = [np.array([number.setdefault(w, len(number)) for w in text.as_py().lower().split()], dtype=np.int32) for text in rows.column("text")]
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    ids, own, words, size = [ids[i] for i in order], own[order], [words[i] for i in order], size[order]
    tables = rows.column("buckets").combine_chunks().take(pa.array(order))
    table = tables[0].as_py().index(bucket)
    earlier = np.array([x.values.slice(0, table).to_numpy() for x in tables])
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()[order].copy()
    different = [np.unique(w, return_counts=True) for w in words]
    kinds, counts = (np.concatenate([x[k] for x in different]) for k in (0, 1))
    many = np.array([len(x[0]) for x in different])
    ends = np.cumsum(many) - many
    mine = np.zeros(len(number), dtype=np.int64)
    reach = np.searchsorted(threshold * size - 1e-9, size, side="right")  # beyond, texts are too long for a link to each
    most = edits_allowed(size, size, threshold)
    found = []
    for i in range(len(ids) - 1):
        end = reach[i]
        if not size[i]:
            continue
        good = label[i + 1 : end] != label[i]
        if not alone:
            good &= own[i + 1 : end] != own[i]
        others = np.flatnonzero(good) + i + 1
        others = others[~(earlier[others] == earlier[i]).any(axis=1)]
        if not len(others):
            continue
        mine[different[i][0]] = different[i][1]
        begins = np.cumsum(many[others]) - many[others]
        at = np.repeat(ends[others] - begins, many[others]) + np.arange(many[others].sum())
        common = np.add.reduceat(np.minimum(counts[at], mine[kinds[at]]), begins)
        mine[different[i][0]] = 0
        for j in others[size[others] - common <= most[others]]:
            if label[j] == label[i]:
                continue
            edits = edit_distance(words[i].tolist(), words[j].tolist(), int(most[j]))
            if edits <= most[j]:
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j]), 1 - edits / int(size[j])))
                label[label == label[j]] = label[i]
    return found


def wider_pairs(going: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Not a step of near_duplicates, which compares whole buckets (in_reach, joining_links): the pairs in a window.

    Distinct pairs (a, b), a < b, of different classes, of members of a bucket at most width apart, whose counts of
    words (texts: id, bag) allow a link.

    going (bucket, number, id, n_words, label) has consecutive numbers in each bucket. They are dealt out in blocks of
    at least width members, each with the block before it, so no bucket meets in one task and no pair is lost at a
    border.
    """
    kind = going.schema["id"].dataType.simpleString()
    size = max(width, BLOCK)
    member = going.join(texts.select("id", "bag"), "id")
    block = F.floor(F.col("number") / size)
    member = member.select(F.explode(F.array(block, block + 1)).alias("block"), (block).alias("own"), "*")
    parts = int(going.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = member.repartition(parts, "block").sortWithinPartitions("block", "number")
    schema = f"a {kind}, b {kind}"
    wanted = arrow_schema(schema)
    small_batches(going.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the rows of the last block so far
        for batch in batches:
            if not batch.num_rows:
                continue
            old = kept.num_rows if kept is not None else 0
            rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            get = lambda name: rows.column(rows.schema.get_field_index(name))
            blocks, bucket, words = get("block").to_numpy(), get("bucket").to_numpy(), get("n_words").to_numpy()
            label = get("label").dictionary_encode().indices.to_numpy()
            mine = (get("own").to_numpy() == blocks) & (np.arange(rows.num_rows) >= old)
            fresh = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (blocks[1:] != blocks[:-1])]))
            longest = int(np.diff(np.append(fresh, rows.num_rows)).max())
            left, right, waiting = [], [], 0
            ids, bag = get("id"), bags_of(get("bag"))
            for d in range(1, min(width, longest - 1) + 1):
                near, far = slice(d, None), slice(None, -d)
                good = mine[near] & (bucket[near] == bucket[far]) & (blocks[near] == blocks[far]) & (label[near] != label[far])
                at = np.flatnonzero(good)
                x, y = words[at], words[at + d]
                at = at[np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9]
                at = at[least_edits(bag[at], bag[at + d]) <= edits_allowed(words[at], words[at + d], threshold)]
                left.append(at)
                right.append(at + d)
                waiting += len(at)
                if waiting >= PAIRS_AT_ONCE:
                    yield put_out(ids, left, right)
                    left, right, waiting = [], [], 0
            if waiting:
                yield put_out(ids, left, right)
            kept = rows.slice(int(np.searchsorted(blocks, blocks[-1])))

    def put_out(ids: pa.Array, left: list, right: list) -> pa.RecordBatch:
        take = lambda at: ids.take(pa.array(np.concatenate(at)))
        return pa.RecordBatch.from_arrays([take(left), take(right)], schema=wanted)

    return dealt.mapInArrow(run, schema).select(*_pair("a", "b")).distinct()


def merged(labels: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """The labels (id, label) after links between their classes, or between ids without one."""
    again = materialise(components(relabelled(links, labels)), f"{label}-again").select(F.col("id").alias("label"), F.col("label").alias("to"))
    moved = labels.join(again, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    fresh = again.select(F.col("label").alias("id"), F.col("to").alias("label")).join(labels, "id", "left_anti")
    return materialise(moved.unionByName(fresh), label)


def _pair(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def hub_pairs(shared: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each member of a bucket with the bucket's hub."""
    often = shared.groupBy("id").agg(F.count("*").alias("times"))
    hubs = shared.select("bucket", "id", "n_words").join(often, "id").groupBy("bucket").agg(F.max(F.struct("times", "id", "n_words")).alias("hub"))
    star = shared.join(hubs.select("bucket", F.col("hub.id").alias("other"), F.col("hub.n_words").alias("size")), "bucket")
    star = star.filter((F.col("id") != F.col("other")) & (F.least("n_words", "size") >= threshold * F.greatest("n_words", "size") - 1e-9))
    return star.select(*_pair("id", "other")).distinct()


def relabelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs between different classes, as distinct pairs of class ids."""
    for x in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("id").alias(x), F.col("label").alias(f"class_{x}")), x, "left")
    apart = pairs.select(*(F.coalesce(f"class_{x}", x).alias(f"class_{x}") for x in ("a", "b"))).filter("class_a <> class_b")
    return apart.select(*_pair("class_a", "class_b")).distinct()


def bags_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BAG)


def least_edits(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Edits that the counts of words of each pair of texts need at least."""
    more = one.astype(np.int16) - two
    return np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))


def edits_allowed(one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    return ((1 - threshold) * np.maximum(one, two) + 1e-9).astype(np.int64)


def like_bags(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs without those whose counts of words (id, n_words, bag) tell that they need too many edits.

    A word that one text has more often than the other is an edit at least. Counts of several words together, and
    counts cut at 255, differ by no more than the words do, so no pair that is similar enough goes.
    """
    side = lambda x: texts.select(F.col("id").alias(x), F.col("n_words").alias(f"n_{x}"), F.col("bag").alias(f"bag_{x}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        edits = least_edits(bags_of(get("bag_a")), bags_of(get("bag_b")))
        keep = pa.array(edits <= edits_allowed(get("n_a").to_numpy(), get("n_b").to_numpy(), threshold))
        return {"a": get("a").filter(keep), "b": get("b").filter(keep)}

    return map_arrow(both.select("a", "b", "n_a", "n_b", "bag_a", "bag_b"), one, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, df: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose texts are similar enough, with their similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    text = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # merge joins at every size: neither side has a bound that would allow a broadcast
    text = text.join(wanted.hint("merge"), "id", "left_semi")
    both = pairs.hint("merge").join(text.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.hint("merge").join(text.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        found = [similar(x.as_py(), y.as_py(), threshold) for x, y in zip(get("text_a"), get("text_b"), strict=True)]
        return {"a": get("a"), "b": get("b"), "similarity": found}

    return map_arrow(both.select("a", "b", "text_a", "text_b"), one, f"a {kind}, b {kind}, similarity double").filter("similarity is not null")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, label): the smallest id that each linked id can reach.

    In each round every id hooks to the smallest id around it, then to what that one hooks to, and the links are
    redrawn between the ids hooked to. Links inside one id vanish, so the graph shrinks fast and a link is joined only
    while its ends still differ. Every round is written to the shared folder; counts alone come back to the driver.
    """
    edges = links.select("a", "b")
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("label"))
    for _ in range(most_rounds):
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        low = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p"))
        hooks = materialise(low.join(low.select(F.col("x").alias("p"), F.col("p").alias("q")), "p").select("x", F.col("q").alias("to")), "hooks")
        labels = labels.join(hooks.select(F.col("x").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        ends = edges.join(hooks.select(F.col("x").alias("a"), F.col("to").alias("to_a")), "a").join(hooks.select(F.col("x").alias("b"), F.col("to").alias("to_b")), "b")
        drawn = ends.filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        edges = materialise(drawn, "edges")
        if not edges.limit(1).count():
            return labels
    raise RuntimeError(f"links are left after {most_rounds} rounds")


def near_duplicates(df: DataFrame, threshold: float = 0.8, tables: int = 24, sample: int = 2, width: int = 5, fine: int = 16, short: int = 8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, labels): members (id, rep) gives every row with an id the smallest id with equal words; links
    (a, b, similarity) are verified pairs of such representatives, all that it takes to join their classes; labels (id,
    label) are these. An id names one row here; near_duplicate_classes takes any rows."""
    own = df.filter(F.col(id_col).isNotNull())
    if repeats(own, id_col):
        raise ValueError(f"{id_col} repeats, so it names no text; near_duplicate_classes numbers the rows")
    sketches = materialise(sketch(own, tables, sample, width, fine, short, id_col, text_col), "sketches")
    rep = sketches.groupBy("digest").agg(F.min("id").alias("rep"))
    members = materialise(sketches.select("id", "digest").join(rep, "digest").select("id", "rep"), "members")
    alone = members.filter("id = rep").select("id")
    texts = materialise(sketches.filter("n_words > 0").drop("digest").join(alone, "id", "left_semi"), "texts")
    bags = texts.select("id", "n_words", "bag")
    shared = materialise(shared_buckets(texts), "shared")
    to_hubs = materialise(like_bags(hub_pairs(shared, threshold), bags, threshold), "hubs")
    to_hubs = verified(to_hubs, own, threshold, id_col, text_col)
    first = materialise(to_hubs.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "hub-links")
    labels = materialise(components(first), "labels")
    going = materialise(mixed(consecutive(shared), labels), "going")
    reached = materialise(in_reach(going, bags, threshold), "reached")
    rest = joining_links(reached, texts, own, threshold, id_col, text_col)
    rest = materialise(rest.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links")
    return members, first.unionByName(rest), merged(labels, rest, "classes")


def repeats(df: DataFrame, id_col: str) -> bool:
    """Whether an id stands in several rows; rows without one don't count."""
    times = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_times"))
    return bool(times.filter("_times > 1").limit(1).count())


def numbered(df: DataFrame, number: str) -> DataFrame:
    """df with numbers of its rows, written once so that they stay."""
    return materialise(df.withColumn(number, F.monotonically_increasing_id()), "numbered")


def classes_of_ids(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(id, label) of every row, whose ids name one row each: the smallest id of its class."""
    members, _, labels = near_duplicates(df, id_col=id_col, text_col=text_col, **how)
    return members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("label"))


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, class_id) of every row with an id: the smallest id of its class; how as in near_duplicates.

    Where an id stands in several rows, the rows are numbered and compared one by one, each with its own text.
    """
    own = df.filter(F.col(id_col).isNotNull())
    if not repeats(own, id_col):
        return classes_of_ids(own, id_col, text_col, **how).select(F.col("id").alias(id_col), F.col("label").alias("class_id"))
    rows = numbered(own.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")), "row")
    labels = classes_of_ids(rows, "row", "text", **how).withColumnRenamed("id", "row")
    member = materialise(rows.select("row", "own").hint("merge").join(labels, "row"), "row-classes")
    lowest = member.groupBy("label").agg(F.min("own").alias("class_id"))
    return member.hint("merge").join(lowest, "label").select(F.col("own").alias(id_col), "class_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df with one row of each class, of those with its smallest id; rows without an id stay."""
    columns = [f"`{c}`" for c in df.columns]
    if not repeats(df, id_col):
        found = classes_of_ids(df, id_col, text_col, **how).filter("id <> label").select(F.col("id").alias(id_col))
        return df.join(materialise(found, "dropped").hint("merge"), id_col, "left_anti").select(*columns)
    number = "_row"
    while number in (c.lower() for c in df.columns):
        number += "_"
    rows = numbered(df, number)
    own = rows.filter(F.col(id_col).isNotNull()).select(F.col(number).alias("row"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    labels = classes_of_ids(own, "row", "text", **how).withColumnRenamed("id", "row")
    member = materialise(own.select("row", "own").hint("merge").join(labels, "row"), "row-classes")
    first = member.groupBy("label").agg(F.min(F.struct("own", "row")).alias("first")).select("first.row")
    dropped = member.select("row").join(first.hint("merge"), "row", "left_anti").select(F.col("row").alias(number))
    return rows.join(dropped.hint("merge"), number, "left_anti").select(*columns)
