"""Sequence functions on string columns: length, GC content, type, reverse complement, slices.

All are built-in expressions, so they stay inside generated code and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters and their complements.
LETTERS, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
#: Letters of nucleotide sequences, with gaps.
NUCLEOTIDES = "ACGTRYSWKMBDHVNU.-"
#: Where a FASTA header's first word has its id; behind a GenBank mark, behind another database's, at its begin.
HEADER_IDS = (r"^\S*gb[|:]([^\s,;|]+)", r"^\S*(?:emb|dbj|sp|tr|ref|lcl)\|([^\s,;|]+)", r"^([^\s,;|]+)")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_letters(data: Column | str, letters: str) -> Column:
    data = col(data)
    return F.length(data) - F.length(F.translate(data, letters, ""))


def gc_content(data: Column | str) -> Column:
    """(G + C) / (G + C + A + T + U); 0 where there is none of them."""
    gc, at = count_letters(data, "GC"), count_letters(data, "ATU")
    return F.when(gc + at > 0, gc / (gc + at)).otherwise(F.lit(0.0))


def sequence_type(data: Column | str) -> Column:
    """nt if every letter is a nucleotide code, a gap or U, else aa; the empty string is nt."""
    return F.when(col(data).rlike("[^ACGTRYSWKMBDHVNU.-]"), "aa").otherwise("nt")


def reverse(data: Column | str) -> Column:
    return F.reverse(col(data))


def complement(data: Column | str) -> Column:
    """Complement of all IUPAC letters; with any U in it, the result is RNA. Other letters stay."""
    data = col(data)
    rna = F.translate(F.translate(F.translate(data, "U", "T"), LETTERS, COMPLEMENTS), "T", "U")
    return F.when(F.contains(data, F.lit("U")), rna).otherwise(F.translate(data, LETTERS, COMPLEMENTS))


def reverse_complement(data: Column | str) -> Column:
    return F.reverse(complement(data))


def slice_range(length: Column, start: int | None, stop: int | None) -> tuple[Column, Column]:
    """Begin and end, within the string, of the Python slice [start:stop]."""

    def place(i: int | None, default: Column) -> Column:
        if i is None:
            return default
        return F.least(F.lit(i), length) if i >= 0 else F.greatest(length + i, F.lit(0))

    return place(start, F.lit(0)), place(stop, length)


def slice_text(data: Column | str, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """data[start:stop:step] with Python's rules, negative places and steps included."""
    data = col(data)
    length = F.length(data)
    if step == 1:
        begin, end = slice_range(length, start, stop)
        return F.substring(data, begin + 1, F.greatest(end - begin, F.lit(0)))
    if step == 0:
        raise ValueError("a slice's step can't be 0")
    return let(letters(data), lambda own: F.array_join(_stepped(own, start, stop, step), ""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression named inside a lambda is otherwise computed at every call."""
    return F.transform(F.array(value), body)[0]


def _stepped(own: Column, start: int | None, stop: int | None, step: int) -> Column:
    length = F.size(own)
    if step > 0:
        begin, end = slice_range(length, start, stop)
        return F.filter(own, lambda c, i: (i >= begin) & (i < end) & (F.pmod(i - begin, F.lit(step)) == 0))

    def place(i: int | None, default: Column) -> Column:
        if i is None:
            return default
        return F.least(F.lit(i), length - 1) if i >= 0 else F.greatest(length + i, F.lit(-1))

    begin, end = place(start, length - 1), place(stop, F.lit(-1))
    return F.reverse(F.filter(own, lambda c, i: (i <= begin) & (i > end) & (F.pmod(begin - i, F.lit(-step)) == 0)))


def letter_at(data: Column | str, i: int) -> Column:
    """data[i]; null beyond the ends."""
    data = col(data)
    place = F.lit(i) if i >= 0 else F.length(data) + i
    return F.when((place >= 0) & (place < F.length(data)), F.substring(data, place + 1, F.lit(1)))


def set_slice(data: Column | str, text: str, start: int, stop: int) -> Column:
    """data with [start:stop] replaced by text."""
    data = col(data)
    begin, end = slice_range(F.length(data), start, stop)
    return F.concat(F.substring(data, F.lit(1), begin), F.lit(text), F.substring(data, F.greatest(begin, end) + 1, F.length(data)))


def letters(data: Column | str) -> Column:
    """Array of all letters, in one pass over the text."""
    return F.regexp_extract_all(col(data), F.lit("(?s)(.)"), F.lit(1))


def kmers(data: Column | str, k: int) -> Column:
    """Array of all overlapping words of k letters; empty if the text is shorter.

    A look-ahead at every place makes them in one pass; substring() at each place would walk from the text's start.
    """
    return F.regexp_extract_all(col(data), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def ungapped_places(data: Column | str, gap: str = "-") -> Column:
    """0-based places of all letters that aren't gaps."""
    placed = F.transform(letters(data), lambda c, i: F.when(~c.isin(*gap), i))
    return F.filter(placed, lambda i: i.isNotNull())


def slice_ungapped(data: Column | str, start: int | None, stop: int | None, gap: str = "-") -> Column:
    """The slice whose ends are counted without gaps: from the start-th letter to behind the one before stop.

    ATG---GGA with [1:5] gives TG---GG.
    """
    data = col(data)
    places = ungapped_places(data, gap)
    begin = F.lit(0) if not start else F.coalesce(F.try_element_at(places, F.lit(start + 1) if start >= 0 else F.lit(start)), F.length(data) if start >= 0 else F.lit(0))
    if stop is None:
        end = F.length(data)
    elif stop == 0:
        end = F.lit(0)
    elif stop > 0:
        end = F.coalesce(F.try_element_at(places, F.lit(stop)) + 1, F.length(data))
    else:
        end = F.coalesce(F.try_element_at(places, F.lit(stop - 1)) + 1, F.lit(0))
    return F.substring(data, begin + 1, F.greatest(end - begin, F.lit(0)))


def id_from_header(header: Column | str) -> Column:
    """Sequence id of a FASTA header: the first of HEADER_IDS that its first word has; null if none fits."""
    header = col(header)
    return F.coalesce(*(F.nullif(F.regexp_extract(header, p, 1), F.lit("")) for p in HEADER_IDS))
