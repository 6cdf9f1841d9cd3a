"""The fuzzy pattern language and its score.

A pattern is atoms between spaces, all of which must hold: 'literal, ^prefix, suffix$, !not, and plain atoms whose characters
must occur in this order.  Filters are regular expressions in the scan.  The score of a plain atom is 16 for each of its
characters, less one for each character skipped in the shortest stretch from its first to its last character (Spark's own
regular expressions find it, leftmost), down to one for each character; other atoms score 16 for each character.  A line in
which the whole pattern occurs as it is scores 65,536 more.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold, fold_text, smart_case_sensitive

EXACT = 1 << 16


def _quote(ch: str) -> str:
    return "\\" + ch if ch in "\\.[]{}()*+-?^$|&~#\"" else ch


def atoms(pattern: str) -> list[tuple[str, str, bool]]:
    """(kind, text, negated) of each atom; kind: fuzzy, exact, prefix, suffix or whole."""
    out = []
    for raw in re.findall(r"(?:\\ |[^\s])+", pattern):
        text, negated = raw.replace("\\ ", " "), False
        if text.startswith("!"):
            text, negated = text[1:], True
        kind = "exact" if negated else "fuzzy"
        if text.startswith("'"):
            kind, text = "exact", text[1:]
        elif text.startswith("^"):
            kind, text = "prefix", text[1:]
        if text.endswith("$") and not text.endswith("\\$"):
            kind, text = "whole" if kind == "prefix" else "suffix", text[:-1]
        if text:
            out.append((kind, text, negated))
    return out


def _stretch(text: str) -> str:
    """A pattern for text's characters in order.  Group 1: from the first character's first place on, each at its first place
    after the one before.  Nothing in it can be given back, so a line costs one pass whether it matches or not."""
    first, *rest = text
    return f"^[^{_quote(first)}]*+({_quote(first)}" + "".join(f"[^{_quote(ch)}]*+{_quote(ch)}" for ch in rest) + ")"


def _holds(line: Column, kind: str, text: str) -> Column:
    if kind == "exact":
        return line.contains(text)
    if kind == "prefix":
        return F.ltrim(line).startswith(text)
    if kind == "suffix":
        return line.endswith(text)
    if kind == "whole":
        return F.trim(line) == text
    return line.rlike(_stretch(text))


def fuzzy_columns(line: Column, pattern: str, case: str = "smart") -> tuple[Column, Column, Column]:
    """Whether a line matches all atoms, its score, and the place of the whole pattern or null."""
    parts = atoms(pattern)
    whole = pattern.strip()
    sensitive = smart_case_sensitive(whole, case)
    line = line if sensitive else fold(line)
    same = (lambda t: t) if sensitive else fold_text
    keep, score = F.lit(bool(parts)), F.lit(0).cast("long")
    for kind, text, negated in parts:
        held = _holds(line, kind, same(text))
        keep &= ~held if negated else held
        if not negated and kind == "fuzzy":
            found = F.regexp_extract(line, _stretch(same(text)), 1)
            score += F.greatest(F.lit(16 * len(text)) - (F.length(found) - len(text)), F.lit(len(text)))
        elif not negated:
            score += 16 * len(text)
    at = F.instr(line, same(whole)) - 1
    at = F.when(at >= 0, at)
    return keep, (score + F.when(at.isNotNull(), EXACT).otherwise(0)).cast("long"), at


def fuzzy_score(lines: DataFrame, pattern: str, case: str = "smart") -> DataFrame:
    """Lines that match all atoms, with `score` and `at`."""
    keep, score, at = fuzzy_columns(F.col("line"), pattern, case)
    return lines.where(keep).withColumns({"at": at, "score": score})
