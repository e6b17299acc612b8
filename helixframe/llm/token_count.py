"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut into pre-tokens as a byte-level vocabulary asks. Within each, the adjacent pair of lowest rank is
popped from a heap and merged in a doubly linked list until no ranked pair is left. The count is the initial number
of byte symbols less the merges; no identifiers are emitted.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; other columns are
not looked at; an empty table gives an empty result. Any length is counted whole.
"""

from __future__ import annotations

import functools
import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow

#: Pre-token pattern of byte-level vocabularies of this family (fixed value); white space by its Unicode property.
_W = r"\p{White_Space}"
_PRE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_W}\p{{L}}\p{{N}}]+|{_W}+(?![^{_W}])|{_W}+"
)
#: White space directly before a space: a cut at that space would split a run of white space.
_RUN = re.compile(r"\s ")
#: Distinct chunks remembered by a worker; when full the memory starts anew, so it is bounded.
CACHE_ENTRIES = 600_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Pair ranks of a byte-level vocabulary in a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        letters = byte_letters()
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = number(letter)
        ranks: dict[int, dict[int, int]] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(number(left), {}).setdefault(number(right), rank)
            self.merged.append(number(left + right))
        #: ranks[left](right) is a pair's rank or None; the last symbol stands for both ends and for merged places.
        self.ranks = [ranks.get(i, {}).get for i in range(len(names) + 1)]
        self.end = len(names)

    def count(self, piece: bytes) -> int:
        """Symbols left of one pre-token after all merges.

        Heap entries are rank << bits | place. An entry is stale if the pair at its place has another rank by now.
        """
        size = len(piece)
        if size < 2:
            return size
        ranks, merged, end = self.ranks, self.merged, self.end
        symbol = [*map(self.first.__getitem__, piece), end]
        bits = size.bit_length()
        mask = (1 << bits) - 1
        heap = [r << bits | i for i in range(size - 1) if (r := ranks[symbol[i]](symbol[i + 1])) is not None]
        heapify(heap)
        after = [*range(1, size + 1), size]
        before = [*range(-1, size)]
        left = size
        while heap:
            entry = heappop(heap)
            i = entry & mask
            rank = entry >> bits
            j = after[i]
            if ranks[symbol[i]](symbol[j]) != rank:
                continue
            symbol[i] = one = merged[rank]
            symbol[j] = end
            k = after[i] = after[j]
            before[k] = i
            left -= 1
            if (r := ranks[one](symbol[k])) is not None:
                heappush(heap, r << bits | i)
            h = before[i]
            if (r := ranks[symbol[h]](one)) is not None:
                heappush(heap, r << bits | h)
        return left


class Counts(dict):
    """Counts by text, filled on demand and bounded; texts over 64 characters aren't remembered."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, text: str) -> int:
        n = self.count(text)
        if len(text) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[text] = n
        return n


class TokenCounter:
    """Counts whole texts as the tokenizers library does with the same file and add_special_tokens=False."""

    def __init__(self, path: str):
        merges = Merges(path)
        find = self.find = regex.compile(_PRE).findall
        self.pieces = pieces = Counts(lambda x: merges.count(x.encode("utf-8", "replace")))
        self.chunks = Counts(lambda x: sum(map(pieces.__getitem__, find(x))))
        self.special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None

    def __call__(self, text: str) -> int:
        if self.special and (parts := self.special.split(text))[1:]:
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        chunks = self.chunks
        if _RUN.search(text):
            return sum(map(self.pieces.__getitem__, self.find(text)))
        head, *rest = text.split(" ")
        return (chunks[head] if head else 0) + sum(map(chunks.__getitem__, map(" ".__add__, rest)))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row: one narrow pass, no shuffle.

    vocabulary: path of a byte-level tokenizers .json, readable on every worker.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        count = counter(vocabulary)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        tokens = [count(x) for x in texts]
        return {id_col: batch.column(0), "n_bytes": [len(x.encode("utf-8", "replace")) for x in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return map_arrow(df.select(id_col, text_col), one, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
