"""Vector best-fit packing of token pieces into sequences.

Every document is cut into pieces of at most `max_tokens`. A piece asks for a vector of three resources: tokens,
documents (1) and attention cost (tokens squared); a sequence has a capacity in each. Pieces are placed in decreasing
order into the open sequence that scores best under every constraint, by

* "norm": the least weighted norm of what would be left over (each resource as a share of its capacity), or
* "dot": the greatest weighted dot product of the piece and what is left.

A new sequence is begun only where no open one takes the piece. All three resources of a piece follow from its length, so pieces of one length are interchangeable. The plan is
therefore made on the histogram of lengths, which has at most `max_tokens` rows however large the corpus is, and
holds for all pieces at once: sequences of equal contents are kept as one row with a multiplicity. Pieces get their
place in the plan by a rank among those of their length; ranks are dealt out in groups of bounded size, so that a
length that holds a third of all pieces is spread over many tasks.

Defined results: a null or empty text gives one piece that holds the end id alone; repeated rows (same id) are
packed like any other rows; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from dataclasses import dataclass, field
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise

#: Distinct words remembered in each of two generations (some 150 bytes an entry).
WORDS = 150_000
#: Rows that are cut and looked up together: more rows share more words, fewer hold less memory.
ROWS = 2000

#: Fixed value: the pattern by which the vocabulary's file cuts lower-case text into words.
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\pZ\s\pL\pN]+)"
#: Letters for which Unicode tables of all versions, lower-casing in and out of context, and composition agree.
_LATIN = "^[\x21-\x7e\u00a1-\u00ff]*$"


class Memory:
    """A bounded memory in two generations: what is asked for again moves to the young one, the old one is let go."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get_all(self, keys: list[str], learn) -> list[bytes]:
        """The values of distinct keys; learn gives those of the keys that aren't remembered."""
        young, old = self.young, self.old
        gaps = [k for k in keys if k not in young]
        if gaps:
            again = [k for k in gaps if k in old]
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            new = [k for k in gaps if k not in young] if again else gaps
            if new:
                young.update(zip(new, learn(new), strict=True))
        found = list(map(young.__getitem__, keys))
        if len(young) > self.most:
            self.young, self.old = {}, young
        return found


def _lists(blobs: list[bytes]) -> pa.LargeListArray:
    """Ids, given as bytes, as one list a row."""
    ends = np.fromiter(accumulate(map(len, blobs), initial=0), dtype=np.int64, count=len(blobs) + 1)
    return pa.LargeListArray.from_arrays(pa.array(ends >> 2), pa.array(np.frombuffer(b"".join(blobs), dtype="<u4")))


class WordTokenizer:
    """Ids of whole texts under a vocabulary whose tokens never cross white space.

    A batch of texts is cut at ASCII white space and its chunks are dictionary-encoded by Arrow; distinct chunks are
    lower-cased and cut into words there too. Only distinct words of a batch reach Python: each goes through the
    tokenizers library once and is remembered within a bound. Chunks with letters (or spaces) beyond Latin-1, and
    texts with special tokens, go through the library's whole pipeline.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; idle threads would spin on others'
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for words: neither normalises nor cuts
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = Memory(WORDS)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, special)) or "$^x"

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[bytes]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        data = np.fromiter(chain.from_iterable(found), dtype="<u4").tobytes()
        ends = list(accumulate((4 * len(ids) for ids in found), initial=0))
        return [data[a:b] for a, b in pairwise(ends)]

    def _of_chunks(self, chunks: pa.Array) -> pa.LargeListArray:
        """One list of ids for each of the distinct chunks."""
        plain = pc.match_substring_regex(chunks, _LATIN)
        lower = pc.utf8_lower(pc.if_else(plain, chunks, ""))
        alpha = pc.utf8_is_alpha(lower)
        marked = pc.replace_with_mask(lower, pc.invert(alpha), pc.replace_substring_regex(lower.filter(pc.invert(alpha)), _PIECE, r"\1 "))
        cut = pc.ascii_split_whitespace(marked)
        words = cut.flatten().dictionary_encode()
        ids = _lists(self.words.get_all(words.dictionary.to_numpy(zero_copy_only=False).tolist(), lambda new: self._encode(self.bare, new))).take(words.indices)
        ends = ids.offsets.to_numpy()[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        lists = pa.LargeListArray.from_arrays(pa.array(ends), ids.flatten())
        if pc.all(plain).as_py():
            return lists
        other = pc.invert(plain)
        whole = self._encode(self.tokenizer, chunks.filter(other).to_pylist())
        return _merge(lists, other, _lists(whole))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the last one's end)."""
        odd = pc.match_substring_regex(texts, self.special)
        has_odd = pc.any(odd).as_py()
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts) if has_odd else texts)
        coded = split.flatten().dictionary_encode()
        of_word = self._of_chunks(coded.dictionary).take(coded.indices)
        at = of_word.offsets.to_numpy()[split.offsets.to_numpy() - split.offsets[0].as_py()]
        ids = of_word.values.to_numpy(zero_copy_only=False)
        if not has_odd:
            return ids, at
        parts = np.split(ids, at[1:-1])
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            parts[k] = np.frombuffer(self._encode(self.tokenizer, [texts[int(k)].as_py()])[0], dtype="<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _merge(lists: pa.LargeListArray, mask: pa.BooleanArray, new: pa.LargeListArray) -> pa.LargeListArray:
    """lists with the rows under mask replaced, in order, by those of new."""
    under = mask.to_numpy(zero_copy_only=False)
    at = np.arange(len(lists))
    at[under] = len(lists) + np.arange(len(new))
    return pa.concat_arrays([lists, new]).take(pa.array(at))


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECES = "id {kind}, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, vocabulary: str, max_tokens: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document: its ids, then end_id, cut every max_tokens."""
    kind = df.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        tokenize, end = word_tokenizer(vocabulary), int(end_id).to_bytes(4, "little")
        out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for first in range(0, batch.num_rows, ROWS):
            texts = pc.fill_null(batch.column(1).slice(first, ROWS), "")
            ids, at = tokenize(texts)
            data, at = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B"), at.tolist()
            for row, (low, high) in enumerate(pairwise(at), first):
                n = high - low + 1  # with the end id
                for k, start in enumerate(range(0, n, max_tokens)):
                    size = min(max_tokens, n - start)
                    own = data[4 * (low + start) : 4 * min(low + start + size, high)]
                    crc = zlib.crc32(own)
                    del own
                    out["row"].append(row)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(end, crc) if start + size == n else crc)
            del texts, ids, data, at
            pa.default_memory_pool().release_unused()
        return out | {"id": batch.column(0).take(pa.array(out["row"], pa.int64()))}

    return map_arrow(df.select(id_col, text_col), one, PIECES.format(kind=kind))


@dataclass
class Capacity:
    """What a sequence can hold, and how much each resource counts for the choice of a sequence.

    Attention cost is the sum of squared lengths. By default documents and attention may be what 4096 tokens allow at
    most, so that no sequence is begun for their sake (fewest sequences under the tokens' limit); their residuals
    count in the choice all the same. Lower capacities forbid placements; tests show both.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    score: str = "norm"


@dataclass
class Plan:
    """Ranks [lo, hi) of `length` go to sequences from `first`, `copies` in each, from `offset` on."""

    length: list[int] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


def _shares(open_: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """What is left of each resource, as a share of its capacity; rows of open_ are (first, count, tokens, documents, attention)."""
    return (scale - open_[:, 2:]) / scale


def _takes(open_: np.ndarray, fits: np.ndarray, todo: int, ask: np.ndarray, scale: np.ndarray, cap: Capacity) -> np.ndarray:
    """How many of `todo` equal pieces go to each row of sequences, piece after piece to the best-scoring sequence.

    The norm of what is left falls with each piece that a sequence takes, so the best one is filled up before the
    next. The dot product falls too, so there the k-th piece of every sequence stands in line by its own score.
    """
    left, weights = _shares(open_, scale), np.array(cap.weights, dtype=float)
    if cap.score == "norm":
        order = np.argsort(((left - ask) ** 2) @ weights, kind="stable")
        room = (open_[:, 1] * fits)[order]
        before = np.cumsum(room) - room
        out = np.zeros(len(open_), dtype=np.int64)
        out[order] = np.clip(todo - before, 0, room)
        return out
    row = np.repeat(np.arange(len(open_)), fits)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(fits) - fits, fits)
    key = (left @ (weights * ask))[row] - turn * float(weights @ ask**2)
    order = np.argsort(-key, kind="stable")
    room = open_[row[order], 1]
    before = np.cumsum(room) - room
    return np.bincount(row[order], np.clip(todo - before, 0, room), len(open_)).astype(np.int64)


def plan_packing(histogram: dict[int, int], cap: Capacity) -> Plan:
    """Vector best-fit decreasing over the histogram {length: number of pieces}.

    Sequences with equal contents are one row with a count. A length splits a few rows at most, so there are no more
    than a few rows for each length, however many pieces there are; each length is placed by vectorised steps over
    all rows. A new sequence is begun only if no open one takes the piece under every constraint.
    """
    plan = Plan()
    limits = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.int64)
    scale = limits.astype(float)
    open_ = np.zeros((0, 5), dtype=np.int64)

    def fill(rows: np.ndarray, amounts: np.ndarray, fits: np.ndarray, vector: np.ndarray, rank: int) -> np.ndarray:
        """Deals ranks out: by norm the first sequences of a row are filled up, by dot product all get equally many."""
        if cap.score == "norm":
            full, rest = np.divmod(amounts, fits)
            parts = [(full, fits), ((rest > 0).astype(np.int64), rest), (rows[:, 1] - full - (rest > 0), np.zeros_like(fits))]
        else:
            each, more = np.divmod(amounts, rows[:, 1])
            parts = [(more, each + 1), (rows[:, 1] - more, each)]
        out, first = [], rows[:, 0].copy()
        for count, copies in parts:
            keep = count > 0
            part = rows[keep].copy()
            part[:, 0], part[:, 1] = first[keep], count[keep]
            placed = copies[keep] > 0
            sizes = (part[:, 1] * copies[keep])[placed]
            plan.length += [int(vector[0])] * len(sizes)
            plan.lo += (rank + np.cumsum(sizes) - sizes).tolist()
            plan.first += part[placed, 0].tolist()
            plan.copies += copies[keep][placed].tolist()
            plan.offset += part[placed, 2].tolist()
            rank += int(sizes.sum())
            part[:, 2:] += copies[keep][:, None] * vector
            out.append(part)
            first += count
        return np.concatenate(out)

    for n in sorted(histogram, reverse=True):
        vector = np.array([n, 1, n * n], dtype=np.int64)
        most = int((limits // vector).min())
        if most < 1:
            raise ValueError(f"a piece of {n} tokens fits no sequence")
        todo, rank = histogram[n], 0
        fits = ((limits - open_[:, 2:]) // vector).min(axis=1)
        able = fits > 0
        if able.any():
            amounts = _takes(open_[able], fits[able], todo, vector / scale, scale, cap)
            used = amounts > 0
            rows = open_[able]
            open_ = np.concatenate([open_[~able], rows[~used], fill(rows[used], amounts[used], fits[able][used], vector, rank)])
            rank += int(amounts.sum())
            todo -= int(amounts.sum())
        if todo:
            full, rest = divmod(todo, most)
            rows = np.array([(plan.sequences, full, 0, 0, 0), (plan.sequences + full, min(rest, 1), 0, 0, 0)], dtype=np.int64)
            amounts = np.array([full * most, rest])
            plan.sequences += full + min(rest, 1)
            keep = rows[:, 1] > 0
            open_ = np.concatenate([open_, fill(rows[keep], amounts[keep], np.array([most, max(rest, 1)])[keep], vector, rank)])
        open_ = open_[(open_[:, 2] < cap.tokens) & (open_[:, 3] < cap.documents) & (open_[:, 4] < cap.attention)]
    return plan


#: Pieces of one length that one task ranks: bounded, and small where the corpus is small.
def group_size(total: int) -> int:
    return max(16, min(1_000_000, total // 100_000))


def with_rank(pieces: DataFrame, histogram: dict[int, int], order: list[str]) -> DataFrame:
    """rank: 0, 1, ... among the pieces of one length, in no particular order over all.

    A length with c pieces is dealt into ceil(c / group_size) hash groups. Pieces are numbered within their group;
    the groups' sizes, summed up over the groups of a length, give each group's first rank.
    """
    spark = pieces.sparkSession
    size = group_size(sum(histogram.values()))
    groups = spark.createDataFrame([(int(n), -(-c // size)) for n, c in histogram.items()], "length long, groups long")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("grp", F.pmod(F.xxhash64(*order), F.col("groups"))).drop("groups")
    sizes = dealt.groupBy("length", "grp").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    within = Window.partitionBy("length", "grp").orderBy(*order)
    numbered = dealt.withColumn("k", F.row_number().over(within) - 1)
    return numbered.join(first, ["length", "grp"]).withColumn("rank", F.col("first_rank") + F.col("k")).drop("grp", "k", "first_rank")


def assign(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Adds sequence_id and offset. The plan's size depends on max_tokens only, so it travels with the task."""
    columns = {k: np.array(getattr(plan, k), dtype=np.int64) for k in ("length", "lo", "first", "copies", "offset")}
    by = np.lexsort((columns["lo"], columns["length"]))
    columns = {k: v[by] for k, v in columns.items()}
    span = 1 << 44  # ranks stay below it: 17 million million pieces of one length
    keys = columns["length"] * span + columns["lo"]
    kept = ranked.drop("rank").columns

    def one(batch: pa.RecordBatch) -> dict:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        length, rank = get("length").to_numpy(), get("rank").to_numpy()
        at = np.searchsorted(keys, length * span + rank, side="right") - 1
        seq, place = np.divmod(rank - columns["lo"][at], columns["copies"][at])
        return {k: get(k) for k in kept} | {"sequence_id": columns["first"][at] + seq, "offset": columns["offset"][at] + place * length}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_arrow(ranked, one, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocabulary: str, cap: Capacity | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    The pieces (a few dozen bytes each, no texts) are written once to the shared folder, so that texts are tokenized
    once and a lost executor costs a reread only.
    """
    cap = cap or Capacity()
    spark = df.sparkSession
    pieces = materialise(cut_pieces(df, vocabulary, cap.tokens, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most cap.tokens rows
    if not histogram:
        return spark.createDataFrame([], f"{id_col} {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    plan = plan_packing(histogram, cap)
    out = assign(with_rank(pieces, histogram, ["id", "piece", "start", "ids_crc32"]), plan)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
