"""Regular expression matches with positions, by reading frame."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import COMPLEMENTS, LETTERS, reverse_complement
from .codes import bases, codons, complement_table, marked, raw

#: Start and stop codons in both spellings.
START_CODONS = ("AUG", "ATG")
STOP_CODONS = ("UAG", "UAA", "UGA", "TAG", "TAA", "TGA")
FRAMES = (0, 1, 2, -1, -2, -3)

#: Results that a task holds before it gives them on, and texts that it reads at a time.
RESULTS, TEXTS = 1 << 15, 64

MATCHES = "seq_ord long, seqid string, seqlen int, rf int, start int, stop int, raw_start int, raw_stop int, match string"


def frames(rf: int | str | Sequence[int]) -> tuple[int, ...]:
    """Frames by name, in the order 0, 1, 2, -1, -2, -3."""
    named = {"fwd": FRAMES[:3], "bwd": FRAMES[3:], "all": FRAMES, "both": FRAMES}
    wanted = named[rf] if isinstance(rf, str) else (rf,) if isinstance(rf, int) else tuple(rf)
    if not set(wanted) <= set(FRAMES):
        raise ValueError(f"frames are among {FRAMES}")
    return tuple(f for f in FRAMES if f in wanted)


def match_codons(seqs: DataFrame, words: Sequence[str], rf: int | str | Sequence[int] = "fwd", start: int = 0) -> DataFrame:
    """All places of codons that can't overlap each other, such as start or stop codons; one vectorised pass."""
    wanted = frames(rf)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            letters, offsets = raw(batch.column(2))
            table, parts, held = marked(tuple(words)), [], 0
            for k, (low, high) in enumerate(pairwise(offsets.tolist())):
                own = bases(letters[low:high])
                for strand in (1, -1):
                    if not any((f >= 0) == (strand > 0) for f in wanted):
                        continue
                    at = np.flatnonzero(table[codons(own if strand > 0 else complement_table()[own[::-1]])])
                    frame = (at - start) % 3
                    signed = frame if strand > 0 else -frame - 1
                    keep = (at >= start) & np.isin(signed, wanted)
                    at, signed = at[keep], signed[keep]
                    parts.append((np.full(len(at), k), np.full(len(at), high - low), signed, at if strand > 0 else high - low - at - 3, at))
                    held += len(at)
                if held >= RESULTS:
                    yield from _codon_batches(batch, letters, offsets, parts)
                    parts, held = [], 0
            if parts:
                yield from _codon_batches(batch, letters, offsets, parts)

    return seqs.select("ord", "id", "data").mapInArrow(run, MATCHES)


def _codon_batches(batch: pa.RecordBatch, letters: np.ndarray, offsets: np.ndarray, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of RESULTS matches of parts, which are (row, size, frame, start, raw start) of a sequence's strand."""
    every = [np.concatenate(c) for c in zip(*parts, strict=True)]
    for low in range(0, len(every[0]), RESULTS):
        row, size, signed, begin, at = (x[low : low + RESULTS] for x in every)
        # a word is read where it lies: forward as it is, backward from its complement
        words = letters[(offsets[row] + begin)[:, None] + np.arange(3)]
        back = signed < 0
        words[back] = _turned(words[back])
        texts = pa.StringArray.from_buffers(len(row), pa.py_buffer(np.arange(0, 3 * len(row) + 1, 3, dtype=np.int32)), pa.py_buffer(words.tobytes()))
        values = [batch.column(0).take(pa.array(row)).cast(pa.int64()), batch.column(1).take(pa.array(row)).cast(pa.string()), *(pa.array(x, pa.int32()) for x in (size, signed, begin, begin + 3, at, at + 3)), texts]
        yield pa.RecordBatch.from_arrays(values, names=["seq_ord", "seqid", "seqlen", "rf", "start", "stop", "raw_start", "raw_stop", "match"])


_TURN = np.arange(256, dtype=np.uint8)
_TURN[list(map(ord, LETTERS))] = list(map(ord, COMPLEMENTS))
_TURN[ord("U")] = ord("A")


def _turned(words: np.ndarray) -> np.ndarray:
    """Reverse complements of words, a row each; those with a U are spelled with U."""
    out = _TURN[words][:, ::-1]
    return np.where((words == ord("U")).any(axis=1, keepdims=True) & (out == ord("T")), np.uint8(ord("U")), out)


def texts_of(batches: Iterator) -> Iterator[tuple]:
    """The rows of batches, of which TEXTS are read at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, TEXTS):
            yield from zip(*(c.to_pylist() for c in batch.slice(low, TEXTS).columns), strict=True)


def batches_of(rows: Iterator[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of RESULTS rows."""
    while part := list(islice(rows, RESULTS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def with_gaps(pattern: str, gap: str) -> str:
    """The pattern with gaps allowed between neighbouring letters or dots."""
    inner = f"[{gap}]*"
    return re.sub(r"(?<=[^\W\d_]|\.)(?=[^\W\d_]|\.)", inner, pattern)


def matches_of(text: str, backwards: str, pattern: str, rf: tuple[int, ...] | None, start: int, gap: str | None) -> Iterator[tuple[int | None, int, int, str]]:
    """(frame, begin, end, match) on the strand that is scanned; gaps before a match don't count for its frame."""
    expression = re.compile(pattern if gap is None else with_gaps(pattern, gap))
    for strand, own in ((1, text), (-1, backwards)):
        if rf is None and strand < 0 or rf is not None and not any((f >= 0) == (strand > 0) for f in rf):
            continue
        at, gaps = start, 0
        for m in expression.finditer(own):
            if m.start() < start:
                continue
            if gap is not None and rf is not None:
                gaps += sum(own.count(g, at, m.start()) for g in gap)
                at = m.start()
            frame = None if rf is None else (m.start() - start - gaps) % 3
            if frame is not None and strand < 0:
                frame = -frame - 1
            if rf is None or frame in rf:
                yield frame, m.start(), m.end(), m[0]


def match(seqs: DataFrame, pattern: str, rf: int | str | Sequence[int] | None = "fwd", start: int = 0, gap: str | None = "-", matchall: bool = True) -> DataFrame:
    """Matches of a Python pattern; 'start' and 'stop' name the codons. matchall=False keeps the first of a sequence.

    The patterns 'start' and 'stop' on sequences without gaps are found as numbers of codons; others as expressions.
    """
    named = {"start": START_CODONS, "stop": STOP_CODONS}
    if pattern in named and gap is None and rf is not None:
        found = match_codons(seqs, named[pattern], rf, start)
        if matchall:
            return found
        first = F.min_by(F.struct(*found.columns), F.struct(F.when(F.col("rf") >= 0, 0).otherwise(1), "raw_start")).alias("m")
        return found.groupBy("seq_ord").agg(first).select("m.*")
    expression = "|".join(named[pattern]) if pattern in named else pattern
    wanted = None if rf is None else frames(rf)

    def run(batches: Iterator) -> Iterator:
        names = ["seq_ord", "seqid", "seqlen", "rf", "start", "stop", "raw_start", "raw_stop", "match"]
        kinds = [pa.int64(), pa.string(), *[pa.int32()] * 6, pa.string()]
        yield from batches_of(rows_of(batches), names, kinds)

    def rows_of(batches: Iterator) -> Iterator[tuple]:
        for number, seqid, text, back in texts_of(batches):
            size = len(text)
            for frame, begin, end, found in matches_of(text, back, expression, wanted, start, gap):
                place = (begin, end) if frame is None or frame >= 0 else (size - end, size - begin)
                yield number, seqid, size, frame, *place, begin, end, found
                if not matchall:
                    break

    back = reverse_complement("data") if wanted and any(f < 0 for f in wanted) else F.lit("")
    return seqs.select("ord", "id", "data", back.alias("back")).mapInArrow(run, MATCHES)
