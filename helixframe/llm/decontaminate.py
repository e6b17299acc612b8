"""Benchmark decontamination: CGK embedding, coordinate-sampling LSH and exact edit verification.

The benchmark is a stated set of items; every document is searched for passages within a share of word edits of an
item. Texts are lower-case words between white space and ASCII punctuation.

Windows. For an item of n words and e allowed edits, a passage keeps at least n - q + 1 - q * e of the item's q-grams.
Only windows with that many q-grams of items of n words are looked at; no passage within e edits is lost.

Embedding. Each window of an item's size goes through `walks` random walks (Chakraborty, Goldenberg, Koucky 2016): at
step j the word under the pointer is put out and the pointer moves on if a random bit of (j, word) is set. Texts
within few edits fall back into step, so their embeddings agree in many places: edit distance becomes Hamming
distance. Each of `tables` hash tables a walk takes `sample` places of the embedding as its key; a window and an item
with one common key are candidates.

Verification. The least number of edits between the item and any passage around the window is computed exactly.

Defined results: null and empty texts contain nothing; items without words match nothing; equal items each give their
rows; repeated documents each give theirs; empty tables give empty results; other columns, whatever their names, are not
looked at (drop_contaminated keeps them). Whole texts are searched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches

#: Distinct words whose hash a worker remembers; when full the memory starts anew, so it is bounded.
CACHE_ENTRIES = 600_000
#: Items searched for in one pass over the documents; a larger benchmark takes several passes.
ITEMS_A_PASS = 50_000
_U = np.uint64
_PAD = _U(0x5851F42D4C957F2D)
#: Upper-case ASCII to lower case, ASCII punctuation and controls to a space.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return h


_hashes = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=_U, count=len(words))


def grams(words: np.ndarray, q: int) -> np.ndarray:
    n = len(words) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = words[:n].copy()
    for j in range(1, q):
        out = (out ^ (out >> _U(29))) * _U(0x9E3779B97F4A7C15) + words[j : n + j]
    return out * _U(0xBF58476D1CE4E5B9)


def fewest_edits(item: list[int], passage: list[int]) -> tuple[int, int]:
    """(edits, end): the least edits between the item and any part of the passage, and where the first such part ends.

    Bit-parallel approximate search: one column of differences is one integer of len(item) bits.
    """
    n = len(item)
    letters: dict[int, int] = {}
    for i, x in enumerate(item):
        letters[x] = letters.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = (n, 0)
    for j, x in enumerate(passage, 1):
        match = letters.get(x, 0)
        across = ((((match & up) + up) ^ up) | match | down) & full
        right_up = down | full & ~(across | up)
        right_down = up & across
        score += bool(right_up & top) - bool(right_down & top)
        right_up = right_up << 1 & full
        right_down = right_down << 1 & full
        up = right_down | full & ~(across | right_up)
        down = right_up & across
        if score < best[0]:
            best = (score, j)
    return best


class SizeClass:
    """Items of one number of words: their q-grams and hash tables."""

    def __init__(self, n: int, threshold: float, walks: int, tables: int, sample: int):
        self.n = n
        self.edits = int((1 - threshold) * n + 1e-9)
        self.q = next((q for q in (3, 2, 1) if n - q + 1 - q * self.edits > 0), 1)
        self.least = max(1, n - self.q + 1 - self.q * self.edits)
        rng = np.random.default_rng(n)
        self.steps = 2 * n
        self.bits = rng.integers(0, 2**63, size=(walks, self.steps), dtype=_U) * _U(2) + _U(1)
        self.places = np.sort(rng.integers(0, self.steps, size=(walks, tables, sample)), axis=2)
        self.salt = rng.integers(0, 2**63, size=(walks, tables), dtype=_U)
        self.keys: dict[int, list[int]] = {}

    def embed(self, words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Keys (windows, walks * tables) of the windows of `length` words from each start."""
        walks = len(self.bits)
        padded = np.concatenate([words, np.full(length + 1, _PAD, dtype=_U)])
        at = np.zeros((len(starts), walks), dtype=np.int64)
        out = np.empty((self.steps, len(starts), walks), dtype=_U)
        limit = np.minimum(length, len(words) - starts)[:, None]
        for j in range(self.steps):
            now = np.where(at < limit, padded[starts[:, None] + np.minimum(at, limit)], _PAD)
            out[j] = now
            at += ((now ^ (now >> _U(31))) * self.bits[:, j] >> _U(63)).astype(np.int64)
        key = np.broadcast_to(self.salt, (len(starts), *self.salt.shape)).copy()
        for k in range(self.places.shape[2]):
            taken = np.stack([out[self.places[w, :, k], :, w].T for w in range(walks)], axis=1)
            key = (key ^ taken) * _U(0x9E3779B97F4A7C15)
            key ^= key >> _U(32)
        return key.reshape(len(starts), -1)

    def index(self, items: list[tuple[int, np.ndarray]]) -> None:
        found = defaultdict(set)
        for number, words in items:
            for key in self.embed(words, np.zeros(1, dtype=np.int64), self.n)[0].tolist():
                found[key].add(number)
        self.keys = {k: sorted(v) for k, v in found.items()}
        self.sorted_keys = np.array(sorted(self.keys), dtype=_U)
        self.grams = np.unique(np.concatenate([grams(w, self.q) for _, w in items]))


class Index:
    """All items by size class."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float, walks: int, tables: int, sample: int):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t) for _, t in items]
        self.plain = [w.tolist() for w in self.words]
        by_size = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w):
                by_size[len(w)].append((k, w))
        self.classes = []
        for n in sorted(by_size):
            c = SizeClass(n, threshold, walks, tables, sample)
            c.index(by_size[n])
            self.classes.append(c)
        self.seen: dict[int, np.ndarray] = {}
        for q in {c.q for c in self.classes}:
            self.seen[q] = np.zeros(1 << 22, dtype=bool)  # a first look at a q-gram's top 22 bits
            for c in self.classes:
                if c.q == q:
                    self.seen[q][c.grams >> _U(42)] = True
        self.least = {q: min(c.least for c in self.classes if c.q == q) for q in self.seen}

    def search(self, words: np.ndarray) -> dict[int, tuple[int, int]]:
        """{item's number: (edits, words before the passage's end)} of the best passage of each found item."""
        found: dict[int, tuple[int, int]] = {}
        for q, seen in self.seen.items():
            own = grams(words, q)
            at = np.flatnonzero(seen[own >> _U(42)])
            if len(at) < self.least[q]:
                continue
            own = own[at]
            for c in self.classes:
                if c.q != q or len(at) < c.least:
                    continue
                place = np.searchsorted(c.grams, own)
                hits = at[c.grams[np.minimum(place, len(c.grams) - 1)] == own]
                if len(hits) >= c.least:
                    self._windows(c, words, hits, found)
        return found

    def _windows(self, c: SizeClass, words: np.ndarray, hits: np.ndarray, found: dict[int, tuple[int, int]]) -> None:
        """Windows that begin up to a window's length before a run of enough q-grams."""
        span = c.n + c.edits
        close = hits[c.least - 1 :] - hits[: len(hits) - c.least + 1] <= span - c.q
        if not close.any():
            return
        starts = set()
        for lo, hi in zip(hits[: len(close)][close].tolist(), hits[c.least - 1 :][close].tolist(), strict=True):
            starts.update(range(max(0, hi - span + c.q), lo + 1))
        starts = np.array(sorted(starts), dtype=np.int64)
        tried: dict[int, int] = {}
        for part in range(0, len(starts), 4096):
            some = starts[part : part + 4096]
            keys = c.embed(words, some, span)
            place = np.searchsorted(c.sorted_keys, keys)
            equal = c.sorted_keys[np.minimum(place, len(c.sorted_keys) - 1)] == keys
            for row, column in zip(*np.nonzero(equal), strict=True):
                start = int(some[row])
                for number in c.keys[int(keys[row, column])]:
                    if start < tried.get(number, -1):
                        continue
                    low = max(0, start - c.edits)
                    high = start + span + c.edits
                    tried[number] = start + c.edits + 1  # starts up to here lie in the passage that is aligned now
                    edits, end = fewest_edits(self.plain[number], words[low:high].tolist())
                    if edits <= c.edits and (number not in found or edits < found[number][0]):
                        found[number] = (edits, low + end)


class Search:
    """What a task needs to search; the index is built once in each worker."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float, walks: int, tables: int, sample: int):
        self.how = (items, threshold, walks, tables, sample)
        self.key = xxhash.xxh3_64_hexdigest(repr(self.how).encode("utf-8", "replace"))

    def index(self) -> Index:
        if self.key not in _built:
            _built.clear()
            _built[self.key] = Index(*self.how)
        return _built[self.key]


_built: dict[str, Index] = {}


def searches(benchmark: DataFrame, item_id: str, item_text: str, **how) -> list[Search]:
    """The benchmark, a stated set of queries, in blocks of ITEMS_A_PASS items."""
    rows = [(r[0], r[1]) for r in benchmark.select(item_id, item_text).orderBy(item_id, item_text).toLocalIterator()]
    how = {"threshold": 0.8, "walks": 12, "tables": 8, "sample": 2} | how
    return [Search(rows[k : k + ITEMS_A_PASS], **how) for k in range(0, len(rows), ITEMS_A_PASS)]


def find_passages(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """(id, item, edits, similarity, end_word): the best passage of each item in each document that has one.

    Where both ids have one name, the item's is put out as item_<name>.
    """
    kind = df.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    item = item_id if item_id != id_col else f"item_{item_id}"
    schema = f"{id_col} {kind}, {item} {item_kind}, edits int, similarity double, end_word long"
    out = None
    for search in searches(benchmark, item_id, item_text, **how):

        def one(batch: pa.RecordBatch, search: Search = search) -> dict:
            index = search.index()
            columns: dict[str, list] = {"row": [], item: [], "edits": [], "similarity": [], "end_word": []}
            for row, text in enumerate(batch.column(1).to_pylist()):
                for number, (edits, end) in sorted(index.search(word_hashes(text)).items()):
                    columns["row"].append(row)
                    columns[item].append(index.ids[number])
                    columns["edits"].append(edits)
                    columns["similarity"].append(1 - edits / len(index.plain[number]))
                    columns["end_word"].append(end)
            return columns | {id_col: batch.column(0).take(pa.array(columns["row"], pa.int64()))}

        found = map_arrow(df.select(id_col, text_col), one, schema)
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """df without the rows whose text has a passage of the benchmark; narrow, with all columns."""
    names, schema = df.columns, df.schema
    place = names.index(text_col)
    small_batches(df.sparkSession)
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(schema))
    out = df.select(*(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)))
    for search in searches(benchmark, item_id, item_text, **how):

        def run(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            index = search.index()
            for batch in batches:
                clean = [not index.search(word_hashes(x)) for x in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, kinds)
    return out.toDF(*names)
