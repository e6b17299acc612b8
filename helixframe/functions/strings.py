"""Python's string methods as column expressions, for every row of a basket at once."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col

#: Python's default white space for strip and split.
_WHITE = r"[\s\x1c-\x1f\x85\p{Zs}\p{Zl}\p{Zp}]"


def center(s: Column | str, width: int, fill: str = " ") -> Column:
    """The odd fill letter goes to the left if the width is odd, else to the right."""
    s = col(s)
    pad = F.greatest(F.lit(width) - F.length(s), F.lit(0))
    left = F.floor(pad / 2).cast("int") + F.when((pad % 2 == 1) & F.lit(width % 2 == 1), 1).otherwise(0)
    return F.concat(F.repeat(F.lit(fill), left), s, F.repeat(F.lit(fill), pad - left))


def ljust(s: Column | str, width: int, fill: str = " ") -> Column:
    s = col(s)
    return F.concat(s, F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.length(s), F.lit(0))))


def rjust(s: Column | str, width: int, fill: str = " ") -> Column:
    s = col(s)
    return F.concat(F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.length(s), F.lit(0))), s)


def count(s: Column | str, sub: str) -> Column:
    """Occurrences that don't overlap; the empty string occurs once more than there are letters."""
    s = col(s)
    if not sub:
        return F.length(s) + 1
    return F.floor((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def find(s: Column | str, sub: str, start: int = 0) -> Column:
    return F.locate(sub, col(s), start + 1) - 1


def index(s: Column | str, sub: str) -> Column:
    place = find(s, sub)
    return F.when(place >= 0, place).otherwise(F.raise_error(F.lit("substring not found")))


def rfind(s: Column | str, sub: str) -> Column:
    s = col(s)
    back = F.locate(sub[::-1], F.reverse(s))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(s) - back + 1 - len(sub))


def rindex(s: Column | str, sub: str) -> Column:
    place = rfind(s, sub)
    return F.when(place >= 0, place).otherwise(F.raise_error(F.lit("substring not found")))


def removeprefix(s: Column | str, prefix: str) -> Column:
    s = col(s)
    return F.when(s.startswith(prefix), F.substring(s, F.lit(len(prefix) + 1), F.length(s))).otherwise(s)


def removesuffix(s: Column | str, suffix: str) -> Column:
    s = col(s)
    return F.when(s.endswith(suffix), F.substring(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s) if suffix else s


def startswith(s: Column | str, prefix: str, start: int = 0) -> Column:
    s = col(s)
    return (F.substring(s, F.lit(start + 1), F.length(s)) if start else s).startswith(prefix)


def endswith(s: Column | str, suffix: str) -> Column:
    return col(s).endswith(suffix)


def encode(s: Column | str, encoding: str = "UTF-8") -> Column:
    return F.encode(col(s), encoding)


def isalpha(s: Column | str) -> Column:
    return col(s).rlike(r"^\p{L}+$")


def isascii(s: Column | str) -> Column:
    return ~col(s).rlike(r"[^\x00-\x7f]")


def islower(s: Column | str) -> Column:
    s = col(s)
    return (s == F.lower(s)) & (s != F.upper(s))


def isupper(s: Column | str) -> Column:
    s = col(s)
    return (s == F.upper(s)) & (s != F.lower(s))


def lower(s: Column | str) -> Column:
    return F.lower(col(s))


def upper(s: Column | str) -> Column:
    return F.upper(col(s))


def swapcase(s: Column | str) -> Column:
    """ASCII letters change case."""
    small = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(col(s), small + small.upper(), small.upper() + small)


def _chars(chars: str | None) -> str:
    return _WHITE if chars is None else "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def lstrip(s: Column | str, chars: str | None = None) -> Column:
    return F.regexp_replace(col(s), f"^{_chars(chars)}+", "") if chars != "" else col(s)


def rstrip(s: Column | str, chars: str | None = None) -> Column:
    return F.regexp_replace(col(s), f"{_chars(chars)}+\\z", "") if chars != "" else col(s)


def strip(s: Column | str, chars: str | None = None) -> Column:
    return rstrip(lstrip(s, chars), chars)


def replace(s: Column | str, old: str, new: str, count: int = -1) -> Column:
    s = col(s)
    if count < 0:
        return F.replace(s, F.lit(old), F.lit(new))
    return F.array_join(F.split(s, quoted(old), count + 1), new) if count else s


def quoted(text: str) -> str:
    """A Java pattern that matches just the text."""
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def split(s: Column | str, sep: str | None = None, maxsplit: int = -1) -> Column:
    """By sep, or by runs of white space with none at the ends."""
    if sep is not None:
        return F.split(col(s), quoted(sep), maxsplit + 1 if maxsplit >= 0 else -1)
    bare = strip(s) if maxsplit < 0 else lstrip(s)
    parts = F.split(bare, _WHITE + "+", maxsplit + 1 if maxsplit >= 0 else -1)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(parts)


def rsplit(s: Column | str, sep: str, maxsplit: int = -1) -> Column:
    back = split(F.reverse(col(s)), sep[::-1], maxsplit)
    return F.reverse(F.transform(back, F.reverse))


def splitlines(s: Column | str) -> Column:
    s = F.regexp_replace(col(s), r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])\z", "")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1))


def translate(s: Column | str, table: dict[str, str]) -> Column:
    """table maps single letters to single letters, or to nothing."""
    kept = {k: v for k, v in table.items() if v}
    gone = [k for k, v in table.items() if not v]
    if any(len(k) != 1 or len(v) != 1 for k, v in kept.items()):
        raise ValueError("translate maps single letters")
    return F.translate(col(s), "".join([*kept, *gone]), "".join(kept.values()))


def maketrans(old: str, new: str, delete: str = "") -> dict[str, str]:
    return dict(zip(old, new, strict=True)) | dict.fromkeys(delete, "")
