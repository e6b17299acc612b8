"""Dimension tables: IUPAC codes, genetic codes and substitution matrices."""

from __future__ import annotations

import functools
from itertools import product
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

#: IUPAC nucleotide letters and the bases they stand for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

#: The NCBI standard code; codons in the order of the bases TCAG, the last base fastest.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: Fixed values from the published NCBI tables: number -> (codons that differ from the standard code, start codons).
GENETIC_CODES = {
    1: ("", "TTG CTG ATG"),
    2: ("TGA=W ATA=M AGA=* AGG=*", "ATT ATC ATA ATG GTG"),
    3: ("TGA=W CTT=T CTC=T CTA=T CTG=T ATA=M", "ATA ATG GTG"),
    4: ("TGA=W", "TTA TTG CTG ATT ATC ATA ATG GTG"),
    5: ("TGA=W ATA=M AGA=S AGG=S", "TTG ATT ATC ATA ATG GTG"),
    6: ("TAA=Q TAG=Q", "ATG"),
    9: ("TGA=W AAA=N AGA=S AGG=S", "ATG GTG"),
    10: ("TGA=C", "ATG"),
    11: ("", "TTG CTG ATT ATC ATA ATG GTG"),
    12: ("CTG=S", "CTG ATG"),
    13: ("TGA=W ATA=M AGA=G AGG=G", "TTG ATA ATG GTG"),
    14: ("TAA=Y TGA=W AAA=N AGA=S AGG=S", "ATG"),
    15: ("TAG=Q", "ATG"),
    16: ("TAG=L", "ATG"),
    21: ("TGA=W ATA=M AAA=N AGA=S AGG=S", "ATG GTG"),
    22: ("TCA=* TAG=L", "ATG"),
    23: ("TTA=*", "ATT ATG GTG"),
    24: ("TGA=W AGA=S AGG=K", "TTG CTG ATG GTG"),
    25: ("TGA=G", "TTG ATG GTG"),
    26: ("CTG=A", "CTG ATG"),
    27: ("TAA=Q TAG=Q TGA=W", "ATG"),
    28: ("TAA=Q TAG=Q TGA=W", "ATG"),
    29: ("TAA=Y TAG=Y", "ATG"),
    30: ("TAA=E TAG=E", "ATG"),
    31: ("TAA=E TAG=E TGA=W", "ATG"),
    32: ("TAG=W", "TTG CTG ATT ATC ATA ATG GTG"),
    33: ("TAA=Y TGA=W AGA=S AGG=K", "TTG CTG ATG GTG"),
}
#: Codes whose stop codons also stand for an amino acid.
AMBIVALENT_STOPS = {27: "TGA", 28: "TAA TAG TGA", 31: "TAA TAG"}


class GeneticCode(NamedTuple):
    number: int
    amino: dict[str, str]  # codon, also with ambiguous bases where all readings agree
    starts: frozenset[str]
    maybe_starts: frozenset[str]  # ambiguous codons of which a reading is a start
    stops: frozenset[str]
    maybe_stops: frozenset[str]

    @property
    def codons(self) -> dict[str, set[str]]:
        found: dict[str, set[str]] = {}
        for codon, aa in self.amino.items():
            if set(codon) <= set("ACGT"):
                found.setdefault(aa, set()).add(codon)
        return found


@functools.lru_cache
def genetic_code(number: int = 1) -> GeneticCode:
    if number not in GENETIC_CODES:
        raise KeyError(f"no genetic code {number}; there are {', '.join(map(str, GENETIC_CODES))}")
    changes, starts = GENETIC_CODES[number]
    amino = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), STANDARD, strict=True))
    amino |= dict(x.split("=") for x in changes.split())
    starts = frozenset(starts.split())
    stops = frozenset(AMBIVALENT_STOPS[number].split() if number in AMBIVALENT_STOPS else (c for c, a in amino.items() if a == "*"))
    resolved, maybe_starts, maybe_stops = dict(amino), set(), set()
    for codon in map("".join, product(IUPAC, repeat=3)):
        if codon in amino:
            continue
        readings = {"".join(r) for r in product(*(IUPAC[b] for b in codon))}
        if readings & starts:
            maybe_starts.add(codon)
        if readings & stops:
            maybe_stops.add(codon)
        if len(aas := {amino[r] for r in readings}) == 1:
            resolved[codon] = aas.pop()
    return GeneticCode(number, resolved, starts, frozenset(maybe_starts), stops, frozenset(maybe_stops))


def gcode_table(spark: SparkSession, numbers: list[int] | None = None) -> DataFrame:
    """gcode(tt, codon, aa, is_start, is_astart, is_stop, is_astop); at most 27 * 3375 rows."""
    rows = []
    for n in numbers or GENETIC_CODES:
        g = genetic_code(n)
        for codon in sorted(set(g.amino) | g.maybe_starts | g.maybe_stops):
            rows.append((n, codon, g.amino.get(codon, "X"), codon in g.starts, codon in g.maybe_starts, codon in g.stops, codon in g.maybe_stops))
    return spark.createDataFrame(rows, "tt int, codon string, aa string, is_start boolean, is_astart boolean, is_stop boolean, is_astop boolean")


def parse_submat(text: str) -> dict[str, dict[str, float]]:
    """A substitution matrix in the NCBI text layout: comments, a line of letters, then a line for each letter."""
    letters, found = None, {}
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        fields = line.split()
        if letters is None:
            letters = fields
            continue
        number = float if any("." in x for x in fields[1:]) else int
        found[fields[0]] = dict(zip(letters, map(number, fields[1:]), strict=False))
    return found


def match_matrix(letters: str, match: float = 1, mismatch: float = 0) -> dict[str, dict[str, float]]:
    """A matrix by rule, such as an identity matrix."""
    return {a: {b: match if a == b else mismatch for b in letters} for a in letters}


def submat(name: str, folder: str | None = None) -> dict[str, dict[str, float]]:
    """The matrix in file `name`, or in `folder` by its upper-case name."""
    import os

    places = [name] + ([os.path.join(folder, name.upper())] if folder else [])
    for place in places:
        if os.path.isfile(place):
            with open(place, encoding="utf-8") as file:
                return parse_submat(file.read())
    known = sorted(f for f in os.listdir(folder) if not f.startswith("README")) if folder else []
    raise FileNotFoundError(f"no matrix at {' or '.join(places)}; available: {', '.join(known) or 'none without a folder'}")


def scale_submat(matrix: dict[str, dict[str, float]], scale: float = 1) -> dict[str, dict[str, float]]:
    """Entries by the sum of all absolute entries, times scale; a new matrix."""
    total = sum(abs(v) for row in matrix.values() for v in row.values())
    return {a: {b: v / total * scale for b, v in row.items()} for a, row in matrix.items()}


def submat_table(spark: SparkSession, matrices: dict[str, dict[str, dict[str, float]]]) -> DataFrame:
    rows = [(name, a, b, float(v)) for name, m in matrices.items() for a, row in m.items() for b, v in row.items()]
    return spark.createDataFrame(rows, "name string, a string, b string, score double")
