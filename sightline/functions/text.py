"""Small column helpers shared by everything else."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT = "…"


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank(c: Column) -> Column:
    return F.trim(nz(c)) == ""


def rl(c: Column, regex: str) -> Column:
    """``find`` semantics; never NULL."""
    return F.coalesce(c.rlike(regex), F.lit(False))


def whole(c: Column, regex: str, flags: str = "(?i)") -> Column:
    """The whole value matches."""
    return rl(c, rf"{flags}\A(?:{regex})\z")


def has_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(CUT))).otherwise(c)


def first_match(pairs, default=None) -> Column:
    """``when`` chain over (condition, value): the first that applies wins."""
    out = None
    for cond, val in pairs:
        val = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ordinal(c: Column, values) -> Column:
    return first_match([(c == v, i) for i, v in enumerate(values)], len(values))


def mask(c: Column) -> Column:
    """Up to 8 characters: the first one; longer: the first and last four."""
    return (
        F.when(c.isNull() | (c == ""), F.lit(""))
        .when(F.length(c) <= 8, F.concat(F.left(c, F.lit(1)), F.lit("***")))
        .otherwise(F.concat(F.left(c, F.lit(4)), F.lit(CUT), F.right(c, F.lit(4))))
    )


def masked_value(raw: Column, sensitive: Column) -> Column:
    return F.when(sensitive, mask(raw)).otherwise(F.lit(""))


def short_content_type(ct: Column) -> Column:
    return F.trim(F.split_part(nz(ct), F.lit(";"), F.lit(1)))


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1024.0 * 1024.0)), F.lit(" MB")))
    )


TRIAGE_LABELS = {"NEW": "New", "REVIEWED": "Reviewed", "CONFIRMED": "Confirmed", "FALSE_POSITIVE": "False positive"}


def triage_label(c: Column) -> Column:
    return first_match([(c == k, v) for k, v in TRIAGE_LABELS.items()], "New")


def sarif_level(sev: Column) -> Column:
    return first_match([(sev == "HIGH", "error"), (sev == "MEDIUM", "warning")], "note")
