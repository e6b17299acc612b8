"""Translation of nucleotide sequences with any of the genetic codes.

translate() is one Arrow-batched pass: sequences without gaps are translated by a table lookup for all their codons at
once, gapped ones, whose gaps must be carried over, letter by letter. translate_column() is the same as a column
expression, for use inside larger expressions on short sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dims import GeneticCode, genetic_code
from ..functions.sequence import col
from .codes import raw, translate_bytes


def amino_acid(codon: Column, code: GeneticCode, astop: str = "X") -> Column:
    """Letter of one codon: by its place in the code's 64 letters; ambiguous codons by a list; else X."""
    line = "".join(code.amino[a + b + c] for a in "TCAG" for b in "TCAG" for c in "TCAG")
    ambiguous = {c: aa for c, aa in code.amino.items() if not set(c) <= set("ACGT")} | dict.fromkeys(code.maybe_stops, astop)
    place = [F.instr(F.lit("TCAG"), F.substring(codon, F.lit(k), F.lit(1))) - 1 for k in (1, 2, 3)]
    plain = F.substring(F.lit(line), place[0] * 16 + place[1] * 4 + place[2] + 1, F.lit(1))
    # one text ";AAR:K;AAY:N..." is a small plan; a map of thousands of literals would take Spark minutes to analyse
    known = F.lit("".join(f";{c}:{aa}" for c, aa in sorted(ambiguous.items())))
    at = F.instr(known, F.concat(F.lit(";"), codon, F.lit(":")))
    concrete = (place[0] >= 0) & (place[1] >= 0) & (place[2] >= 0) & (F.length(codon) == 3)
    return F.when(concrete, plain).when(at > 0, F.substring(known, at + 5, F.lit(1))).otherwise("X")


def codons(data: Column | str) -> Column:
    """Array of the whole codons, U read as T."""
    return F.regexp_extract_all(F.translate(col(data), "U", "T"), F.lit("(?s)(.{3})"), F.lit(1))


def translate_column(data: Column | str, complete: bool = False, final_stop: bool | None = None, astop: str = "X", tt: int = 1) -> Column:
    """Amino acids of a sequence without gaps, up to the first stop, or complete with stops as *."""
    code = genetic_code(tt)
    final_stop = complete if final_stop is None else final_stop
    every = codons(data)
    is_stop = lambda c: c.isin(*sorted(code.stops))
    letters = F.transform(every, lambda c: amino_acid(c, code, astop))
    if complete:
        drop = F.coalesce(is_stop(F.try_element_at(every, F.lit(-1))), F.lit(False)) & F.lit(not final_stop)
        kept = F.when(drop, F.slice(letters, F.lit(1), F.greatest(F.size(letters) - 1, F.lit(0)))).otherwise(letters)
    else:
        first = F.array_position(F.transform(every, is_stop), True).cast("int")
        kept = F.when(first > 0, F.slice(letters, F.lit(1), first - (0 if final_stop else 1))).otherwise(letters)
    return F.array_join(kept, "")


def translation_error(data: Column | str, check_start: bool, check_stop: bool, tt: int = 1) -> Column:
    """Why a gapless sequence can't be translated under the checks; null if it can."""
    code = genetic_code(tt)
    every = codons(data)
    first = F.try_element_at(every, F.lit(1))
    out = F.lit(None).cast("string")
    if check_stop:
        stops = F.transform(every, lambda c: c.isin(*sorted(code.stops)))
        at = F.array_position(stops, True)
        out = F.when(at == 0, F.lit("the last codon is no stop codon")).when(at < F.size(every), F.lit("the first stop codon is not at the end")).otherwise(out)
    if check_start:
        bad = first.isNotNull() & ~first.isin(*sorted(code.starts | code.maybe_starts))
        out = F.when(bad, F.concat(F.lit("codon "), first, F.lit(" is no start codon"))).otherwise(out)
    return out


def translate_text(text: str, complete: bool = False, check_start: bool | None = None, check_stop: bool = False, final_stop: bool | None = None, astop: str = "X", gap: str | None = "-", gap_after: int | None = 2, tt: int = 1) -> str:
    """Translation of one sequence, gaps included: a gap is put out at the gap_after-th gap and every third after it."""
    code = genetic_code(tt)
    check_start = not complete if check_start is None else check_start
    final_stop = complete if final_stop is None else final_stop
    out: list[str] = []
    codon, gaps, seen, stopped = "", 0, 0, False
    for i, base in enumerate(text.replace("U", "T")):
        if base == gap:
            gaps += 1
            if gap_after is not None and gaps >= gap_after and (gaps - gap_after) % 3 == 0:
                out.append(gap)
            continue
        codon += base
        if len(codon) < 3:
            continue
        if check_start and not seen and codon not in code.starts and codon not in code.maybe_starts:
            raise ValueError(f"codon {codon} is no start codon")
        seen += 1
        letter = astop if codon in code.maybe_stops else code.amino.get(codon, "X")
        if codon in code.stops:
            at_end = i >= len(text) - 3
            if check_stop and not at_end:
                raise ValueError("the first stop codon is not at the end")
            if at_end or not complete:
                if final_stop:
                    out.append(letter)
                stopped = True
                break
        out.append(letter)
        codon = ""
    if check_stop and not stopped:
        raise ValueError("the last codon is no stop codon")
    return "".join(out)


def translate(seqs: DataFrame, complete: bool = False, check_start: bool | None = None, check_stop: bool = False, final_stop: bool | None = None, astop: str = "X", gap: str | None = "-", gap_after: int | None = 2, tt: int = 1, strict: bool = True) -> DataFrame:
    """seqs with data translated and type aa.

    A sequence that fails a check stops the job; with strict=False its data is null and the column `error` says why.
    """
    code = genetic_code(tt)
    starts_right = not complete if check_start is None else check_start
    ends_right = complete if final_stop is None else final_stop
    names = [c for c in seqs.columns if c not in ("data", "type", "error")]
    how = {"complete": complete, "check_start": starts_right, "check_stop": check_stop, "final_stop": ends_right, "astop": astop, "gap": gap, "gap_after": gap_after, "tt": tt}
    kinds = {f.name: f.dataType for f in seqs.schema}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names] + [T.StructField("data", T.StringType()), T.StructField("type", T.StringType())] + ([] if strict else [T.StructField("error", T.StringType())]))

    def run(batches: Iterator) -> Iterator:
        mark = ord(gap) if gap else None
        good = code.starts | code.maybe_starts
        for batch in batches:
            at = batch.schema.get_field_index("data")
            letters, offsets = raw(batch.column(at))
            missing = batch.column(at).is_null().to_pylist()
            texts, errors = [], []
            for null, low, high in zip(missing, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = letters[low:high]
                error, found = None, None
                if not null:
                    first = own[:3].tobytes().decode("latin1").replace("U", "T")
                    quick = not check_stop and (mark is None or not (own == mark).any()) and (not starts_right or len(first) < 3 or first in good)
                    try:
                        found = translate_bytes(own, tt, complete, ends_right, astop).decode() if quick else translate_text(own.tobytes().decode("utf-8"), **how)
                    except ValueError as e:
                        if strict:
                            raise
                        error = str(e)
                texts.append(found)
                errors.append(error)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(texts, pa.string()), pa.array(["aa"] * len(texts), pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([] if strict else [pa.array(errors, pa.string())]), names=[f.name for f in schema])

    return seqs.select(*names, "data").mapInArrow(run, schema)
