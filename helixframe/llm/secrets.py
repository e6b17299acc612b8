"""Secret scan: all rules in one byte pass of one combined automaton.

Every rule is a head and then a run of body characters; a PEM key has its key material behind the run. The rules, each up to the shortest body that can count, are
compiled together, by subset construction and minimisation, into one automaton that may start anywhere. One pass over
the bytes of a text tells where each rule's match can first end. From there the rule's reversed automaton finds the
leftmost start and its forward automaton, whose run has no end, the longest end. Matches of a kind don't overlap; those whose body or whole is too short are dropped, and the search goes
on behind them.

Defined results: a null text counts as empty (no spans); repeated rows each give a row; very long texts are scanned
whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Dfa, Parser, reverse
from .common import map_arrow


class Rule(NamedTuple):
    kind: str
    head: str
    body: str  # one character of the run
    fold: bool = False  # letters of the head in either case
    least_body: int = 0
    least: int = 0
    scan: int = 1  # body characters after which the one pass reports the rule; no match has fewer
    tail: str = ""  # an expression for what belongs to the secret behind the run


#: Key material behind a PEM header up to its END line (line ends may be blanks or escaped); without one, its long lines.
PEM_TAIL = r"(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+\n)*+(?:[A-Za-z0-9+/=\s\\]*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{16,}+={0,2})*+)"

#: The first three kinds are the base rules; the others follow formats that issuers have published.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", True, 6),
    Rule("access", r"AKIA", r"[A-Z0-9]", least=20),
    Rule("hex", r"", r"[0-9a-f]", least=24, scan=24),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", least=40),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", least=15),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]", least=39),
    Rule("stripe", r"[rs]k_live_", r"[A-Za-z0-9]", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]"),
    Rule("pem", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY", r"-", least_body=5, scan=5, tail=PEM_TAIL),
)
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        heads = [Parser(r.head, r.fold).parse() for r in rules]
        bodies = [Parser(r.body).parse() for r in rules]
        short = [("cat", [h, ("rep", b, r.scan, r.scan)]) for h, b, r in zip(heads, bodies, rules, strict=True)]
        self.all = Dfa(short, unanchored=True)
        self.backward = [Dfa([reverse(t)]) for t in short]
        self.forward = [Dfa([("cat", [h, ("rep", b, 1, None)])]) for h, b in zip(heads, bodies, strict=True)]
        self.heads = [Dfa([h]) for h in heads]
        self.tails = [re.compile(r.tail.encode()) if r.tail else None for r in rules]
        none = self.all.sets.index(frozenset())
        self.hit = re.compile(b"[^" + re.escape(bytes([none])) + b"]")

    def spans(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(start, rule number, end, body's start) in bytes, by start and then rule."""
        found = []
        resume = [0] * len(self.rules)
        marks = self.all.marks(data)
        sets = self.all.sets
        at = 0
        while hit := self.hit.search(marks, at):
            at = hit.start() + 1
            for k in sets[marks[at - 1]]:
                if at <= resume[k]:
                    continue
                back = self.backward[k].longest(data, at, resume[k], -1)
                if back < 0:
                    continue
                start = at - back
                end = start + self.forward[k].longest(data, start, len(data))
                rule = self.rules[k]
                body = start + max(0, self.heads[k].longest(data, start, end)) if rule.head else start
                if self.tails[k] and (tail := self.tails[k].match(data, end)):
                    end = tail.end()
                resume[k] = end
                if end - body >= rule.least_body and end - start >= rule.least:
                    found.append((start, k, end, body))
        return sorted(found)


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def to_code_points(data: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    if data.isascii():
        return {p: p for p in places}
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += len(data[at:p].decode("utf-8", "replace"))
        out[p] = n
        at = p
    return out


SPANS = "array<struct<kind:string,start:long,end:long,body:long>>"


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets): every span as (kind, start, end, start of the secret itself), in code points, end exclusive.

    Ordered by start and then by the order of the rules. One narrow pass, no shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        scan = scanner(rules)
        out = []
        for data in batch.column(1).to_pylist():
            spans = scan.spans(data or b"")
            at = to_code_points(data, [p for s, _, e, b in spans for p in (s, e, b)]) if spans else {}
            out.append([{"kind": rules[k].kind, "start": at[s], "end": at[e], "body": at[b]} for s, k, e, b in spans])
        return {id_col: batch.column(0), "secrets": out}

    return map_arrow(df.select(F.col(id_col), F.col(text_col).cast("binary").alias("bytes")), one, f"{id_col} {kind}, secrets {SPANS}")


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[{}]") -> DataFrame:
    """df with each secret (overlapping ones together) in text replaced by its kind in brackets.

    All rows and columns stay, null texts stay null; length_col, where df has it, becomes the new number of code points.
    """
    names = df.columns
    schema = df.schema
    place = names.index(text_col)
    counted = length_col if length_col in names else None

    def one(batch: pa.RecordBatch) -> dict:
        scan = scanner(rules)
        columns = {f"c{k}": batch.column(k) for k in range(batch.num_columns)}
        texts, lengths = [], []
        for data in batch.column(place).to_pylist():
            if data is None:
                texts.append(None)
                lengths.append(None)
                continue
            parts, at = [], 0
            for _, k, end, body in sorted(scan.spans(data), key=lambda x: (x[3], -x[2])):
                if body >= at:
                    parts += [data[at:body], mark.format(rules[k].kind).encode()]
                at = max(at, end)
            text = b"".join([*parts, data[at:]]).decode("utf-8", "replace") if parts else data.decode("utf-8", "replace")
            texts.append(text)
            lengths.append(len(text))
        columns[f"c{place}"] = texts
        if counted:
            old = columns[f"c{names.index(counted)}"].to_pylist()
            columns[f"c{names.index(counted)}"] = [o if n is None else n for o, n in zip(old, lengths, strict=True)]
        return columns

    plain = df.select(*(F.col(f"`{n}`").cast("binary").alias(f"c{k}") if k == place else F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)))
    out = map_arrow(plain, one, ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(schema)))
    return out.toDF(*names)


def digest(df: DataFrame, base: tuple[str, ...] = BASE, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the base kinds' spans, and all spans as one string."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    own = F.filter("secrets", lambda s: s.kind.isin(*base))
    number = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in base]
    return df.select(id_col, *counts, F.sha2(text(own), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
