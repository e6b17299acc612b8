"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only.

A pattern's matches and the gaps between them come from regexp_extract_all and split with one and the same pattern;
adding up their lengths gives each match's place in code points. Matches of a kind don't overlap; a match that its
validator turns down is dropped and not tried again. Patterns are written with possessive runs that begin at a run's
start, so that a text of any length is searched in linear time and without deep recursion.

Defined results: a null text counts as empty (no spans); repeated rows each give a row; very long texts are searched
whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def is_card(match: Column) -> Column:
    """13 to 19 digits that pass the Luhn check."""
    number = digits(match)
    return F.length(number).between(13, 19) & F.call_function("luhn_check", number)


def is_ip(match: Column) -> Column:
    return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def is_phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


def is_iban(match: Column) -> Column:
    """The rest by 97 of the number, country and check digits last, letters as 10 to 35, is 1."""
    plain = F.replace(match, F.lit(" "))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1)


class Kind(NamedTuple):
    name: str
    gate: str  # a text without a match of this has no span
    pattern: str
    valid: Callable[[Column], Column] | None
    score: float
    context: str  # words before the span that make it likelier


#: The first four kinds are the base kinds.
KINDS = (
    Kind("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.8, "e-?mail|contact|correo|courriel|write|reply"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", is_ip, 0.5, r"\bip\b|address|host|server|login"),
    Kind("card", "[0-9]", r"[0-9](?:[\x20-]?[0-9])++", is_card, 0.7, "card|visa|master|credit|amex|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone, 0.6, "phone|call|tel|mobile|fax|whatsapp"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", is_iban, 0.9, "iban|bank|account|konto|cuenta|compte"),
)
BASE = ("email", "ip", "card", "phone")
#: Code points between the match before and a span in which context words count, and what one adds to the score.
NEAR, BONUS = 40, 0.2
#: Matches that are added up together.
CHUNK = 256

SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def spans_of(kind: Kind, text: Column) -> Column:
    """Array of (kind, start, end, score) of one kind, in order."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pieces = F.arrays_zip(gaps.alias("gap"), matches.alias("hit"))
    none = F.array().cast(SPAN)

    def step(state: Column, piece: Column) -> Column:
        hit = piece["hit"]
        start = state["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(hit), F.lit(0))
        before = F.lower(F.right(piece["gap"], F.lit(NEAR)))
        score = F.lit(kind.score) + F.when(before.rlike(kind.context), F.lit(BONUS)).otherwise(F.lit(0.0))
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))
        good = hit.isNotNull() if kind.valid is None else hit.isNotNull() & kind.valid(hit)
        return F.struct(end.alias("at"), F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def from_place(at: Column) -> Column:
        return F.struct(at.alias("at"), none.alias("found"))

    def by_chunks(all_pieces: Column) -> Column:
        """The state after each chunk of pieces; growing one array by all spans would cost their number squared."""
        chunks = F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / CHUNK).cast("int"))
        first = F.array(from_place(F.lit(0).cast("long")))
        return F.aggregate(chunks, first, lambda done, k: F.concat(done, F.array(F.aggregate(F.slice(all_pieces, k * CHUNK + 1, F.lit(CHUNK)), from_place(F.element_at(done, -1)["at"]), step))))

    states = F.transform(F.array(pieces), by_chunks)[0]  # the one-element array lets the pieces be made once
    found = F.flatten(F.transform(states, lambda x: x["found"]))
    return F.when(text.rlike(kind.gate), found).otherwise(none)


def find_pii(df: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii): every confirmed span as (kind, start, end, score), by kind as listed and then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col), F.concat(*(spans_of(k, text) for k in kinds)).alias("pii"))


def digest(df: DataFrame, base: tuple[str, ...] = BASE, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the base kinds' spans, all spans and their scores as strings."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    number = lambda kind: F.size(F.filter("pii", lambda s: s.kind == kind)).cast("long")
    own = F.filter("pii", lambda s: s.kind.isin(*base))
    scores = F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s.score)), ",")
    counts = [number(k).alias(f"n_{k}") for k in base]
    return df.select(id_col, *counts, F.sha2(text(own), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"), scores.alias("scores"))
