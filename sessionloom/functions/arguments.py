"""Arguments on the driver: range references, dates; and ages as expressions."""

from __future__ import annotations

import re
from datetime import UTC, datetime, time, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ref(ref: str) -> tuple[str, tuple[int, int | None] | None]:
    """`id#N`, `id#N-M`, `id#N-`, `id#-M` after the last #: the id and a half-open 0-based range (None: to the end).

    0, inverted ranges and other texts are errors; a reference without # is a whole session."""
    head, sep, spec = ref.rpartition("#")
    if not sep:
        return ref, None
    m = re.fullmatch(r"(\d*)(-?)(\d*)", spec)
    if not m or not (m[1] or m[3]):
        raise ValueError(f"not a range: {spec!r}")
    first = int(m[1]) if m[1] else 1
    last = int(m[3]) if m[3] else None if m[2] else first
    if first == 0 or last == 0 or (last is not None and last < first):
        raise ValueError(f"not a range: {spec!r}")
    return head, (first - 1, last)


def bounded(span: tuple[int, int | None], n: int) -> tuple[int, int]:
    """A range within a session of n messages; beyond it is an error."""
    start, end = span[0], n if span[1] is None else span[1]
    if start >= n or end > n:
        raise ValueError(f"{start + 1}-{end} is beyond {n} messages")
    return start, end


def parse_date(text: str, end: bool = False, zone: tzinfo = UTC) -> datetime:
    """RFC 3339, or a bare date: its first second, or for an end its last, in the zone (the earlier of two)."""
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        day = datetime.strptime(text, "%Y-%m-%d").date()
        return datetime.combine(day, time(23, 59, 59) if end else time(), zone).replace(fold=0).astimezone(UTC)
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(UTC)


def relative_age(ts: Column, now: Column) -> Column:
    """now, 5m, 3h, 2d, 6w, 4mo or 1y ago, from whole units."""
    s = F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds(ts))
    whole = lambda unit: F.floor(s / unit).cast("string")
    return (
        F.when(s < 60, "now")
        .when(s < 3600, F.concat(whole(60), F.lit("m")))
        .when(s < 86400, F.concat(whole(3600), F.lit("h")))
        .when(s < 7 * 86400, F.concat(whole(86400), F.lit("d")))
        .when(s < 60 * 86400, F.concat(whole(7 * 86400), F.lit("w")))
        .when(s < 365 * 86400, F.concat(whole(30 * 86400), F.lit("mo")))
        .otherwise(F.concat(whole(365 * 86400), F.lit("y")))
    )


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
