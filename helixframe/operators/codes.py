"""Vectorised passes over the letters of sequences, for the Arrow-batched operators.

A sequence is an array of bytes; its bases are numbers 0 to 3 in the order TCAG (U counts as T), other letters 4 (or,
by IUPAC, a set of bases). Codons are then numbers that index a table, so a pass costs a few operations on arrays,
and memory is a few bytes for each letter, however long a sequence is.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from ..functions.dims import IUPAC, GeneticCode

OTHER = 4
_BASES = "TCAG"


@functools.cache
def base_table() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.uint8)
    for k, c in enumerate(_BASES):
        table[ord(c)] = k
    table[ord("U")] = 0
    return table


@functools.cache
def complement_table() -> np.ndarray:
    """The number of the complementary base, by a base's number."""
    return np.array([_BASES.index({"T": "A", "C": "G", "A": "T", "G": "C"}[b]) for b in _BASES] + [OTHER], dtype=np.uint8)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, one after another; where each begins and the last one ends); a null text is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def bases(letters: np.ndarray) -> np.ndarray:
    return base_table()[letters]


def codons(numbers: np.ndarray) -> np.ndarray:
    """For each place, the number of the codon that begins there; 64 where a letter isn't a base."""
    if len(numbers) < 3:
        return np.zeros(0, dtype=np.uint8)
    a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
    found = a * np.uint8(16) + b * np.uint8(4) + c
    found[(a == OTHER) | (b == OTHER) | (c == OTHER)] = 64
    return found


def codon_number(word: str) -> int:
    a, b, c = (base_table()[ord(x)] for x in word)
    return int(a) * 16 + int(b) * 4 + int(c)


def marked(words: tuple[str, ...]) -> np.ndarray:
    """A table that tells whether a codon's number is one of the words'."""
    table = np.zeros(65, dtype=bool)
    table[[codon_number(w) for w in words]] = True
    return table


@functools.cache
def _iupac_table() -> np.ndarray:
    """1 to 15 by the set of bases a letter stands for, in a fixed order; 0 for other letters."""
    table = np.zeros(256, dtype=np.uint16)
    for k, c in enumerate(IUPAC, 1):
        table[ord(c)] = k
    table[ord("U")] = table[ord("T")]
    return table


@functools.lru_cache(maxsize=64)
def amino_table(code: GeneticCodeKey) -> tuple[np.ndarray, np.ndarray]:
    """(letter, whether it is a stop) by the number of a codon of IUPAC letters."""
    number, astop = code
    from ..functions.dims import genetic_code

    own: GeneticCode = genetic_code(number)
    letters = np.full(4096, ord("X"), dtype=np.uint8)
    stops = np.zeros(4096, dtype=bool)
    at = {c: k for k, c in enumerate(IUPAC, 1)}
    place = lambda codon: at[codon[0]] * 256 + at[codon[1]] * 16 + at[codon[2]]
    for codon, aa in own.amino.items():
        letters[place(codon)] = ord(aa)
    for codon in own.maybe_stops:
        letters[place(codon)] = ord(astop)
    for codon in own.stops:
        stops[place(codon)] = True
    return letters, stops


GeneticCodeKey = tuple[int, str]


def translate_bytes(letters: np.ndarray, tt: int, complete: bool, final_stop: bool, astop: str) -> bytes:
    """Amino acids of a sequence without gaps: whole codons, up to the first stop or complete."""
    n = len(letters) // 3
    if not n:
        return b""
    numbers = _iupac_table()[letters[: 3 * n]].reshape(n, 3)
    bad = (numbers == 0).any(axis=1)
    place = numbers[:, 0] * 256 + numbers[:, 1] * 16 + numbers[:, 2]
    amino, stops = amino_table((tt, astop))
    out = amino[place]
    out[bad] = ord("X")
    ends = stops[place] & ~bad
    if complete:
        return (out[:-1] if ends[-1] and not final_stop else out).tobytes()
    first = int(ends.argmax()) if ends.any() else -1
    return (out[: first + final_stop] if first >= 0 else out).tobytes()


def words_of(letters: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words of k <= 8 letters, whether a word lies within one text) at every place of all texts."""
    base, end = int(offsets[0]), int(offsets[-1])
    own = letters[base:end]
    n = max(0, len(own) - k + 1)
    out = np.zeros(n, dtype=np.uint64 if k > 4 else np.uint32)
    for j in range(k):
        out <<= out.dtype.type(8)
        out |= own[j : n + j]
    inside = np.ones(n, dtype=bool)
    for border in (offsets[1:-1] - base).tolist():
        inside[max(0, border - k + 1) : border] = False
    return out, inside


def word_texts(numbers: np.ndarray, k: int) -> list[str]:
    return [int(x).to_bytes(k, "big").decode("ascii") for x in numbers.tolist()]
