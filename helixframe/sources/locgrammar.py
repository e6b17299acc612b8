"""Locations as GenBank and EMBL write them."""

from __future__ import annotations

import re

from ..functions.locations import DEFECTS

_BASE = re.compile(r"([<>]?)(\d+|\?)(?:(\.\.|\.|\^)([<>]?)(\d+|\?))?$")


def split_top(text: str) -> list[str]:
    """Parts between commas that lie in no bracket."""
    if "(" not in text:
        return text.split(",")
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [*parts, text[at:]]


def parse_location(text: str, strand: str = "+") -> list[dict]:
    """Locations as dicts (start, stop, strand, defect, seqid), 0-based and half open, in the order written.

    complement(..) turns the strand, join(..) and order(..) list parts, acc:range names another sequence.
    """
    text = "".join(text.split())
    for word in ("complement", "join", "order"):
        if text.startswith(word + "(") and text.endswith(")"):
            inner = text[len(word) + 1 : -1]
            if word == "complement":
                return parse_location(inner, {"+": "-", "-": "+"}.get(strand, strand))
            return [x for part in split_top(inner) for x in parse_location(part, strand)]
    seqid = None
    if ":" in text:
        seqid, text = text.rsplit(":", 1)
    found = _BASE.match(text)
    if not found:
        raise ValueError(f"no location: {text!r}")
    low, begin, sign, high, end = found.groups()
    defect = 0
    if low == "<" or high == "<":
        defect |= DEFECTS["BEYOND_LEFT"]
    if high == ">" or low == ">":
        defect |= DEFECTS["BEYOND_RIGHT"]
    if sign == ".":
        defect |= DEFECTS["UNKNOWN_SINGLE_BETWEEN"]
    if sign == "^":
        defect |= DEFECTS["BETWEEN_CONSECUTIVE"]
    if begin == "?":
        defect |= DEFECTS["UNKNOWN_LEFT"]
    if end == "?":
        defect |= DEFECTS["UNKNOWN_RIGHT"]
    last = end if sign else begin
    first = begin if begin != "?" else last
    last = last if last != "?" else first
    if first == "?":
        raise ValueError(f"no place is known: {text!r}")
    return [{"start": int(first) - 1, "stop": max(int(last), int(first)), "strand": strand, "defect": defect, "seqid": seqid}]


def ordered(locs: list[dict]) -> list[dict]:
    """As a feature holds them: by start, or by stop downwards on the minus strand."""
    if len(locs) < 2:
        return list(locs)
    if len({x["strand"] for x in locs}) > 1:
        raise ValueError("a feature lies on one strand")
    return sorted(locs, key=lambda x: (-x["stop"], x["start"]) if x["strand"] == "-" else (x["start"], x["stop"]))
