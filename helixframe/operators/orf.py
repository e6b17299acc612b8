"""Open reading frames.

One Arrow-batched pass: codons of a sequence are numbers, and start and stop codons of each strand and frame are sorted
arrays, so the stop of every start is one bisection for all of them. Nothing is shuffled, and memory is a few bytes
for each letter. Gapped sequences, own patterns and need_start='once' take a pass by regular expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import COMPLEMENTS, LETTERS, reverse_complement
from .codes import bases, codons, complement_table, marked, raw
from .match import FRAMES, RESULTS, START_CODONS, STOP_CODONS, batches_of, frames, matches_of, texts_of

def plain_orfs(letters: np.ndarray, rf: tuple[int, ...], need_start: str, need_stop: bool, nested: str, len_ge: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(frame, begins, ends, has_start, has_stop) on the strand scanned, for each frame of a sequence without gaps."""
    size = len(letters)
    forward = bases(letters)
    out = []
    for strand in (1, -1):
        own = [f for f in rf if (f >= 0) == (strand > 0)]
        if not own:
            continue
        found = codons(forward if strand > 0 else complement_table()[forward[::-1]])
        every_start, every_end = np.flatnonzero(marked(START_CODONS)[found]), np.flatnonzero(marked(STOP_CODONS)[found]) + 3
        for frame in own:
            phase = frame if frame >= 0 else -frame - 1
            if size <= phase:
                continue
            starts, ends = every_start[every_start % 3 == phase], every_end[every_end % 3 == phase]
            last = size - (size - phase) % 3
            closed = np.append(ends, last)  # the end of each segment; the last one is open
            segment = np.searchsorted(ends, starts, side="right")
            if need_start == "always":
                first = np.append(True, segment[1:] != segment[:-1]) if len(starts) else np.zeros(0, dtype=bool)
                # once a stop lies within two places of the end, the search is over: only the first start counts
                many = first | ((segment < len(ends)) & (closed[segment] < size - 2)) if nested == "all" else first
                begin, at = starts[many], segment[many]
                has_start = np.ones(len(begin), dtype=bool)
            else:
                begin, at = np.append(phase, ends), np.arange(len(closed))
                has_start = np.isin(begin, starts)
            end, has_stop = closed[at], at < len(ends)
            keep = (begin < end) & (end - begin >= len_ge) & (has_stop | (not need_stop))
            out.append((frame, begin[keep], end[keep], has_start[keep], has_stop[keep]))
    return out


def _native(seqs: DataFrame, rf: tuple[int, ...], need_start: str, need_stop: bool, nested: str, len_ge: int, with_data: bool) -> DataFrame:
    names = ["seq_ord", "seqid", "seqlen", "strand", "rf", "begin", "end", "has_start", "has_stop", "data"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            letters, offsets = raw(batch.column(2))
            row, frame, columns, texts, held = [], [], [], [], 0
            for k, (low, high) in enumerate(pairwise(offsets.tolist())):
                own = letters[low:high]
                text = own.tobytes().decode("latin1") if with_data else ""
                for f, begin, end, has_start, has_stop in plain_orfs(own, rf, need_start, need_stop, nested, len_ge):
                    row.append(np.full(len(begin), k))
                    frame.append(np.full(len(begin), f, dtype=np.int32))
                    columns.append((begin, end, has_start, has_stop))
                    if with_data:
                        back = text if f >= 0 else _turned(text)
                        texts += [back[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                    held += len(begin)
                if held >= RESULTS:
                    yield gathered(batch, offsets, row, frame, columns, texts)
                    row, frame, columns, texts, held = [], [], [], [], 0
            if row:
                yield gathered(batch, offsets, row, frame, columns, texts)

    def gathered(batch: pa.RecordBatch, offsets: np.ndarray, row: list, frame: list, columns: list, texts: list) -> pa.RecordBatch:
        at, rf_ = np.concatenate(row), np.concatenate(frame)
        sizes = np.diff(offsets)
        rest = [np.concatenate(c) for c in zip(*columns, strict=True)]
        values = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), sizes[at], np.where(rf_ >= 0, "+", "-"), rf_, *rest, texts if with_data else pa.nulls(len(at), pa.string())]
        return pa.RecordBatch.from_arrays([v.cast(t) if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names)

    return seqs.select("ord", "id", "data").mapInArrow(run, "seq_ord long, seqid string, seqlen int, strand string, rf int, begin long, end long, has_start boolean, has_stop boolean, data string")


_TURN = str.maketrans(LETTERS, COMPLEMENTS)


def _turned(text: str) -> str:
    """Reverse complement, as sequence.reverse_complement makes it."""
    if "U" in text:
        return text.replace("U", "T").translate(_TURN).replace("T", "U")[::-1]
    return text.translate(_TURN)[::-1]


def orfs_of(text: str, back: str, rf: tuple[int, ...], start: str, stop: str, need_start: str, need_stop: bool, nested: str, gap: str | None, len_ge: int) -> list[tuple[int, int, int, bool, bool]]:
    """(frame, begin, end, has_start, has_stop) on the strand scanned, in list order; nested='no' is left to the caller."""
    size = len(text)
    by_frame: dict[int, tuple[list[int], list[int]]] = {f: ([], []) for f in rf}
    for k, pattern in enumerate((start, stop)):
        for frame, begin, end, _ in matches_of(text, back, pattern, rf, 0, gap):
            by_frame[frame][k].append(end if k else begin)
    from_place: dict[bool, int] = {}
    if need_start == "once":
        for f, begin, *_ in orfs_of(text, back, rf, start, stop, "always", need_stop, "other", gap, len_ge):
            from_place.setdefault(f >= 0, begin)
    out = []
    for frame in rf:
        starts, stops = by_frame[frame]
        known = set(starts)
        own = text if frame >= 0 else back
        phase = frame if frame >= 0 else -frame - 1

        def open_end() -> int:
            return size if gap is not None and any(g in text for g in gap) else size - (size - phase) % 3

        def put(begin: int, end: int, has_stop: bool) -> None:
            if begin < end and end - begin >= len_ge:
                out.append((frame, begin, end, begin in known, has_stop))

        if need_start == "always":
            last, over, k = 0, None, 0
            for begin in starts:
                if over is not None and begin < over:
                    if nested == "all" and last < size - 2:
                        put(begin, over, True)
                    continue
                if over is not None and over >= size - 2:
                    break
                while k < len(stops) and stops[k] <= begin:
                    k += 1
                if k == len(stops):
                    if not need_stop:
                        put(begin, open_end(), False)
                    break
                over = last = stops[k]
                k += 1
                put(begin, over, True)
            continue
        if need_start == "once" and (frame >= 0) not in from_place:
            continue
        begin = from_place.get(frame >= 0, 0) if need_start == "once" else 0
        count = begin
        for i in range(begin, size):
            if gap is None or own[i] not in gap:
                if count % 3 == phase:
                    begin = count
                    break
                count += 1
        else:
            continue
        for end in stops:
            if end <= begin:
                continue
            put(begin, end, True)
            begin = end
        if not need_stop and begin < size - 2:
            put(begin, open_end(), False)
    return out


def find_orfs(seqs: DataFrame, rf: int | str | Sequence[int] = "all", start: str = "start", stop: str = "stop", need_start: str = "always", need_stop: bool = True, nested: str = "other", gap: str | None = None, len_ge: int = 0, ftype: str = "ORF", with_data: bool = False) -> DataFrame:
    """Open reading frames of all sequences, with their frame in list order (0, 1, 2, -1, -2, -3, then place).

    with_data adds their nucleotides, cut where they are found, as `data`.
    """
    if need_start not in ("always", "once", "never") or nested not in ("no", "other", "all"):
        raise ValueError("need_start is always, once or never; nested is no, other or all")
    wanted = frames(rf)
    if start == "start" and stop == "stop" and gap is None and need_start != "once":
        found = _native(seqs, wanted, need_start, need_stop, nested, len_ge, with_data)
    else:
        found = _general(seqs, wanted, start, stop, need_start, need_stop, nested, gap, len_ge)
    forward = F.col("strand") == "+"
    out = found.select(
        "seq_ord", "seqid", F.lit(ftype).alias("type"),
        F.when(forward, F.col("begin")).otherwise(F.col("seqlen") - F.col("end")).cast("long").alias("start"),
        F.when(forward, F.col("end")).otherwise(F.col("seqlen") - F.col("begin")).cast("long").alias("stop"),
        "strand", "rf", "has_start", "has_stop", "seqlen", *(["data"] if with_data and "data" in found.columns else []),
    ).filter(F.col("stop") - F.col("start") >= len_ge)
    if with_data and "data" not in out.columns:
        out = orf_sequences(seqs, out)
    if nested != "no":
        return out
    rank = F.array_position(F.array(*map(F.lit, FRAMES)), F.col("rf"))
    window = Window.partitionBy("seq_ord").orderBy("start", F.desc("stop"), rank).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("_reach", F.max("stop").over(window)).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("stop"))).drop("_reach")


def _general(seqs: DataFrame, rf: tuple[int, ...], start: str, stop: str, need_start: str, need_stop: bool, nested: str, gap: str | None, len_ge: int) -> DataFrame:
    start = "|".join(START_CODONS) if start == "start" else start
    stop = "|".join(STOP_CODONS) if stop == "stop" else stop

    def run(batches: Iterator) -> Iterator:
        names = ["seq_ord", "seqid", "seqlen", "strand", "rf", "begin", "end", "has_start", "has_stop"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        yield from batches_of(rows_of(batches), names, kinds)

    def rows_of(batches: Iterator) -> Iterator[tuple]:
        for number, seqid, text, back in texts_of(batches):
            for f, begin, end, has_start, has_stop in orfs_of(text, back, rf, start, stop, need_start, need_stop, nested, gap, len_ge):
                yield number, seqid, len(text), "+" if f >= 0 else "-", f, begin, end, has_start, has_stop

    return seqs.select("ord", "id", "data", reverse_complement("data").alias("back")).mapInArrow(run, "seq_ord long, seqid string, seqlen int, strand string, rf int, begin long, end long, has_start boolean, has_stop boolean")


def orf_sequences(seqs: DataFrame, orfs: DataFrame) -> DataFrame:
    """orfs with their nucleotides, those of the minus strand reverse-complemented."""
    joined = orfs.join(seqs.select(F.col("ord").alias("seq_ord"), "data"), "seq_ord")
    part = F.substring("data", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    return joined.withColumn("data", F.when(F.col("strand") == "-", reverse_complement(part)).otherwise(part))
