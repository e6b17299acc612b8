"""Quality by weak supervision: rules vote or abstain, EM estimates how far each can be trusted.

Every rule looks at counts of a whole text and votes bad (0), abstains (1) or votes good (2). The votes of all
documents are counted by pattern (at most 3 ** number of rules, however large the corpus is). Expectation-maximisation
over these counts, started from the rules' majority, estimates the share of good documents and, for each rule, how
often it casts each vote on good and on bad ones. A document's posterior probability of being good follows from its
pattern; it is kept from `threshold` on, unless a base rule rejects it outright.

Defined results: a null text has no words and fails the base rule; repeated rows each give a row and each count as a
vote; an empty table gives an empty result; other columns pass through filter_quality untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, small_batches

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
BAD, ABSTAIN, GOOD = 0, 1, 2


class Counts(NamedTuple):
    """Counts over one whole text; words are runs of other bytes than SPACE."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_distinct: int
    n_capitals: int
    n_letters: int
    n_digits: int
    n_shouts: int
    n_marks: int


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 3 words that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: k for k, w in enumerate(set(words))}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    base = len(number)
    if base < 2_000_000:
        key = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)
        key = pair * base + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    for k in range(3):
        cover[k : n - 2 + k] |= again
    return int(cover.sum())


_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARK = re.compile(b"[" + re.escape(SYMBOLS) + b"]+")


def count(data: bytes) -> Counts:
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    without = lambda chars: len(data) - len(data.translate(None, chars))
    capitals = without(_CAPITALS)
    size = len(data.decode("utf-8", "replace"))
    return Counts(
        n_words=len(words),
        word_chars=size - without(SPACE),
        n_symbols=without(SYMBOLS),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
        n_lines=len(lines),
        n_distinct=len(set(words)),
        n_capitals=capitals,
        n_letters=capitals + without(_SMALL),
        n_digits=without(_DIGITS),
        n_shouts=data.count(b"!!"),
        n_marks=len(_MARK.findall(data)),
    )


def share(part: float, whole: float, good: float, bad: float) -> int:
    """Good up to the one share, bad beyond the other, else no vote; no vote on nothing."""
    if not whole:
        return ABSTAIN
    return BAD if part > bad * whole else GOOD if part <= good * whole else ABSTAIN


class QualityRule(NamedTuple):
    name: str
    vote: Callable[[Counts], int]


#: At most 3 ** len(RULES) patterns of votes.
RULES = (
    QualityRule("symbols", lambda c: share(c.n_symbols, c.word_chars, 0.01, 0.05)),
    QualityRule("marks", lambda c: share(c.n_marks, c.n_words, 0.05, 0.2)),
    QualityRule("repeats", lambda c: share(c.n_repeat_words, c.n_words, 0.1, 0.5)),
    QualityRule("variety", lambda c: share(c.n_words - c.n_distinct, c.n_words, 0.5, 0.7)),
    QualityRule("capitals", lambda c: share(c.n_capitals, c.n_letters, 0.1, 0.3)),
    QualityRule("shouts", lambda c: share(c.n_shouts, c.n_words, 0.02, 0.1)),
    QualityRule("lines", lambda c: share(c.n_dup_lines, c.n_lines if c.n_lines > 2 else 0, 0.05, 0.6)),
    QualityRule("lengths", lambda c: share(abs(c.word_chars - 6 * c.n_words), c.n_words, 2.0, 4.0)),
    QualityRule("digits", lambda c: share(c.n_digits, c.word_chars, 0.1, 0.3)),
)


class Model(NamedTuple):
    """prior: share of good documents. chances[rule][0 bad, 1 good][vote]."""

    prior: float
    chances: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being good for each row of votes."""
        with np.errstate(divide="ignore"):
            logs = np.log(self.chances)
            odds = np.log(self.prior) - np.log1p(-self.prior)
        for k in range(patterns.shape[1]):
            odds = odds + logs[k, 1, patterns[:, k]] - logs[k, 0, patterns[:, k]]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Of each rule: how often a vote that it casts is right."""
        right = self.prior * self.chances[:, 1, GOOD] + (1 - self.prior) * self.chances[:, 0, BAD]
        cast = self.prior * (1 - self.chances[:, 1, ABSTAIN]) + (1 - self.prior) * (1 - self.chances[:, 0, ABSTAIN])
        return right / np.maximum(cast, 1e-12)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, smooth: float = 1.0) -> Model:
    """EM over distinct vote patterns and how often each occurs.

    It starts from the share of bad votes: two rules against a document make it a bad one to begin with.
    """
    n_rules = patterns.shape[1]
    counts = counts.astype(float)
    bad = (patterns == BAD).sum(axis=1)
    good = np.where(bad >= 2, 0.05, np.where(bad == 1, 0.7, 0.98))
    model = Model(0.9, np.full((n_rules, 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        total = weight.sum(axis=1)
        prior = float((total[1] + smooth) / (total.sum() + 2 * smooth))
        chances = np.empty((n_rules, 2, 3))
        for k in range(n_rules):
            for vote in (BAD, ABSTAIN, GOOD):
                chances[k, :, vote] = (weight * (patterns[:, k] == vote)).sum(axis=1) + smooth
        chances /= chances.sum(axis=2, keepdims=True)
        before, model = model, Model(prior, chances)
        good = model.posterior(patterns)
        if np.abs(model.chances - before.chances).max() < 1e-9:
            break
    return model


class BaseRule(NamedTuple):
    """What is rejected whatever the rules say: too few words, or too large a share of words repeated in windows."""

    least_words: int = 50
    most_repeated: float = 0.5

    def failed(self, c: Counts) -> bool:
        return c.n_words < self.least_words or c.n_repeat_words > self.most_repeated * c.n_words


def pattern_code(c: Counts, rules: tuple[QualityRule, ...] = RULES) -> int:
    code = 0
    for r in rules:
        code = code * 3 + r.vote(c)
    return code


def decode(codes: np.ndarray, n_rules: int) -> np.ndarray:
    return np.stack([codes // 3 ** (n_rules - 1 - k) % 3 for k in range(n_rules)], axis=1).astype(np.int64)


COUNTS = ", ".join(f"{k} long" for k in Counts._fields)


def measure(df: DataFrame, rules: tuple[QualityRule, ...] = RULES, base: BaseRule = BaseRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the counts, base_failed, pattern) of every row: one narrow pass."""
    kind = df.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        found = [count(x or b"") for x in batch.column(1).to_pylist()]
        columns = dict(zip(Counts._fields, zip(*found, strict=True), strict=True))
        return columns | {id_col: batch.column(0), "base_failed": [base.failed(c) for c in found], "pattern": [pattern_code(c, rules) for c in found]}

    plain = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("bytes"))
    return map_arrow(plain, one, f"{id_col} {kind}, {COUNTS}, base_failed boolean, pattern long")


def fit_patterns(measured: DataFrame, n_rules: int) -> tuple[Model, dict[int, float]]:
    """The model, and each occurring pattern's probability of being good.

    What reaches the driver is one row for each pattern: at most 3 ** n_rules, and few in practice.
    """
    rows = sorted((r["pattern"], r["count"]) for r in measured.groupBy("pattern").count().collect())
    codes = np.array([p for p, _ in rows], dtype=np.int64)
    patterns = decode(codes, n_rules)
    model = fit(patterns, np.array([n for _, n in rows], dtype=np.int64))
    return model, dict(zip(codes.tolist(), model.posterior(patterns).tolist(), strict=True))


def judge_quality(df: DataFrame, rules: tuple[QualityRule, ...] = RULES, base: BaseRule = BaseRule(), threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, quality): quality is the posterior probability.

    The counts (no texts) are written once to the shared folder; the patterns' probabilities, at most
    3 ** len(rules) rows, are broadcast. Other columns of df, whatever their names, are not looked at.
    """
    if id_col in (*Counts._fields, "base_failed", "pattern", "kept", "quality"):
        raise ValueError(f"{id_col} is the name of a result: rename the id column")
    spark = df.sparkSession
    measured = materialise(measure(df, rules, base, id_col, text_col), "quality")
    _, good = fit_patterns(measured, len(rules))
    known = spark.createDataFrame(list(good.items()), "pattern long, quality double")
    judged = measured.join(F.broadcast(known), "pattern")
    return judged.select(id_col, *Counts._fields, "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality")


def filter_quality(df: DataFrame, rules: tuple[QualityRule, ...] = RULES, base: BaseRule = BaseRule(), threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df that judge_quality keeps, with all their columns.

    Two narrow passes over the texts (votes, then verdicts) and no shuffle of texts.
    """
    spark = df.sparkSession
    numbered = df.select(F.lit(0).alias("one"), F.col(f"`{text_col}`").alias("text"))
    _, good = fit_patterns(measure(numbered, rules, base, "one", "text"), len(rules))
    names, schema = df.columns, df.schema
    place = names.index(text_col)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count((x or "").encode("utf-8", "replace")) for x in batch.column(place).to_pylist()]
            kept = [not base.failed(c) and good.get(pattern_code(c, rules), 1.0) >= threshold for c in found]
            yield batch.filter(pa.array(kept, pa.bool_()))

    renamed = df.toDF(*(f"c{k}" for k in range(len(names))))
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(schema))
    return renamed.mapInArrow(run, kinds).toDF(*names)
