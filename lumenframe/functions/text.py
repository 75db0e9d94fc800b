"""Functions whose dialects' meaning differs from Spark's builtin of a like name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_slice(array: Column, first: int, last: int) -> Column:
    """``a[first:last]`` with 1-based places, both included."""
    return F.slice(array, first, max(0, last - first + 1))


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """The regular expression of a SIMILAR TO pattern, over the whole text.

    ``%`` and ``_`` stand for any text and any character, line ends too; ``| * + ? { } ( )``
    and classes mean what they do in regular expressions; all else is itself.
    """
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if escape and c == escape and at + 1 < len(pattern):
            out.append(re.escape(pattern[at + 1]))
            at += 1
        elif c == "[":
            end = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] == "^"))
            if end < 0:
                raise ValueError(f"a class is not closed in {pattern}")
            out.append("[" + pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            at = end
        else:
            out.append(".*" if c == "%" else "." if c == "_" else c if c in "|*+?{}()" else re.escape(c))
        at += 1
    return "(?s)^(?:" + "".join(out) + ")\\z"


def similar_to(text: Column, pattern: str, escape: str = "\\") -> Column:
    return text.rlike(similar_pattern(pattern, escape))


def glob_pattern(pattern: str) -> str:
    """The regular expression of a GLOB pattern: * and ? and [...] over the whole text, case kept."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] in ("!", "^"))) if c == "[" else -1
        if end > 0:
            body = pattern[at + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            at = end
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        at += 1
    return "(?s)^" + "".join(out) + "\\z"


def glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_pattern(pattern))


def div0(a: Column, b: Column) -> Column:
    """DIV0: 0 where the divisor is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """DATEDIFF by boundaries crossed, not by whole units elapsed; units year, quarter, month, week, day, hour, minute, second."""
    s, e = F.date_trunc(unit, start), F.date_trunc(unit, end)
    months = {"year": 12, "quarter": 3, "month": 1}
    if unit in months:
        return (((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)) / months[unit]).cast("long")
    seconds = {"week": 604_800, "day": 86_400, "hour": 3600, "minute": 60, "second": 1}[unit]
    return ((F.unix_timestamp(e) - F.unix_timestamp(s)) / seconds).cast("long")


def time_bucket(width: str, time: Column) -> Column:
    """The start of the fixed-width bucket, counted from 1970, that a timestamp lies in (``time_bucket``, ``date_bin``, ``time_slice``)."""
    return F.window(time, width)["start"]
