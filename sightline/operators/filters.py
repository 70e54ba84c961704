"""Filters and predicates over exchanges and rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import blank, nz, ordinal, rl
from sightline.rules import packs
from sightline.schemas import SEVERITIES


def java_regex_ok(spark, regex: str) -> bool:
    """Whether the JVM accepts the expression. Only a syntax error makes it invalid; any other failure is raised."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(regex)
        return True
    except IllegalArgumentException:  # what PatternSyntaxException is
        return False


def usable_regex(spark, regex: str | None) -> str | None:
    """Blank or invalid: not set."""
    if regex is None or not regex.strip():
        return None
    return regex if java_regex_ok(spark, regex) else None


def in_scope(df: DataFrame, include: str = "", exclude: str = "", column: str = "url") -> Column:
    spark = df.sparkSession
    inc, exc = usable_regex(spark, include), usable_regex(spark, exclude)
    cond = F.lit(True)
    if inc:
        cond = cond & rl(F.col(column), inc)
    if exc:
        cond = cond & ~rl(F.col(column), exc)
    return cond


def scope(ex: DataFrame, include: str = "", exclude: str = "", hosts: DataFrame | None = None) -> DataFrame:
    """Base scope (a host list) AND include AND NOT exclude."""
    out = ex.where(in_scope(ex, include, exclude))
    if hosts is not None:
        out = out.join(hosts.select(F.lower("host").alias("_h")).distinct(), F.lower("host") == F.col("_h"), "left_semi")
    return out


def _before_query(url: Column) -> Column:
    return F.split_part(F.lower(nz(url)), F.lit("?"), F.lit(1))


def is_static_asset(url: Column, content_type: Column) -> Column:
    ct = F.lower(nz(content_type))
    ext = F.regexp_extract(_before_query(url), r"\.([^.]*)$", 1)
    return rl(ct, r"^(?:image|font|audio|video)/") | ct.contains("text/css") | ext.isin(packs.STATIC_EXTENSIONS)


def is_javascript(url: Column, content_type: Column) -> Column:
    ct, p = F.lower(nz(content_type)), _before_query(url)
    return ct.contains("javascript") | ct.contains("ecmascript") | p.endswith(".js") | p.endswith(".mjs")


def is_html(content_type: Column) -> Column:
    return F.lower(nz(content_type)).contains("html")


def is_json(content_type: Column) -> Column:
    return F.lower(nz(content_type)).contains("json")


def is_api(content_type: Column) -> Column:
    ct = F.lower(nz(content_type))
    return ct.contains("json") | ct.contains("/xml") | ct.contains("+xml")


def search_terms(raw: str) -> tuple[list[str], list[str]]:
    """Whitespace terms; ``-term`` excludes, a lone ``-`` is literal."""
    inc, exc = [], []
    for tok in raw.split():
        (exc if len(tok) > 1 and tok[0] == "-" else inc).append(tok[1:] if len(tok) > 1 and tok[0] == "-" else tok)
    return inc, exc


def _quote(term: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)


def search(df: DataFrame, haystack: Column, raw: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """All terms must occur, none of the excluded ones; an invalid expression is taken literally."""
    inc, exc = search_terms(raw)
    flags = "" if case_sensitive else "(?iu)"

    def hit(term: str) -> Column:
        ok = regex and java_regex_ok(df.sparkSession, term)
        return rl(nz(haystack), flags + (term if ok else _quote(term)))

    conds = [hit(t) for t in inc] + [~hit(t) for t in exc]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def all_columns(df: DataFrame) -> Column:
    return F.concat_ws("\n", *[F.col(c).cast("string") for c in df.columns])


def value_filter(df: DataFrame, column: str, excluded) -> DataFrame:
    """Hide listed values; NULL always passes."""
    if not excluded:
        return df
    return df.where(F.col(column).isNull() | ~F.col(column).isin(list(excluded)))


def value_options(df: DataFrame, column: str) -> DataFrame:
    return df.where(nz(F.col(column)) != "").select(column).distinct()


def finding_visible(df: DataFrame, min_severity: str = "INFO", muted=()) -> DataFrame:
    out = df.where(ordinal(F.col("severity"), SEVERITIES) <= SEVERITIES.index(min_severity))
    return out.where(~F.col("category").isin(list(muted))) if muted else out


def host_focus(df: DataFrame, host: str | None, column: str = "host") -> DataFrame:
    return df if host is None else df.where(F.lower(column) == host.lower())


def report_filter(
    rows: DataFrame, annotations: DataFrame, confirmed_only=False, exclude_false_positive=False, bookmarked_only=False
) -> DataFrame:
    """Triage applies where the rows carry it; bookmarks by ``key``."""
    out = rows
    if "triage" in rows.columns:
        if confirmed_only:
            out = out.where(F.col("triage") == "CONFIRMED")
        if exclude_false_positive:
            out = out.where(F.col("triage") != "FALSE_POSITIVE")
    if bookmarked_only:
        out = out.join(annotations.where("bookmarked").select("key").distinct(), "key", "left_semi")
    return out


JS_NOISE_BYTES = 2048


def not_js_noise(assets: DataFrame) -> DataFrame:
    """``assets`` with kind, size, endpoint_count and finding_count."""
    tiny = (F.col("size") < JS_NOISE_BYTES) & (F.col("endpoint_count") == 0) & (F.col("finding_count") == 0)
    return assets.where(~(~blank(F.col("kind")) | tiny))


def js_findings_view(
    rows: DataFrame, severities=(), category: str | None = None, hide_library=False, untested_only=False,
    host: str | None = None, file: str | None = None,
) -> DataFrame:
    """``rows``: JS findings with category, is_library, seen, host and file columns."""
    out = rows
    if severities:
        out = out.where(F.col("severity").isin(list(severities)))
    if category:
        out = out.where(F.col("category") == category)
    if hide_library:
        out = out.where(~F.col("is_library"))
    if untested_only:
        out = out.where(F.col("seen") == F.lit(False))
    if host:
        out = out.where(F.col("host") == host)
    if file:
        out = out.where(F.col("file") == file)
    return out


def newest(df: DataFrame, cap: int, order: str = "first_seq", tie: str | None = None) -> DataFrame:
    """The ``cap`` rows with the largest ``order`` (of equal ones the smallest ``tie``); 0 keeps everything."""
    return keep_newest(df, cap, order, tie) if cap > 0 else df


#: Parts that a round counts, and rows that one task may rank in the end.
PARTS, RANKED = 1024, 100_000


def keep_newest(df: DataFrame, n: int, order: str, tie: str | None = None) -> DataFrame:
    """Exact selection without a sort: rounds of counting narrow the place of the cut.

    The range that holds the cut is divided in ``PARTS`` equal parts and counted, until it
    is one value of ``order``: at most seven rounds for a long, each an aggregate of one
    narrow column that reads only the rows still in range. Rows above the cut are kept by a
    comparison. Rows at the cut are told apart by ``tie`` in the same way: its UTF-8 bytes,
    seven at a time, are numbers in the order of the strings. What is left when one task can
    rank it (``RANKED`` rows), or has no more bytes to tell it apart, is ranked. Rows without
    ``order`` come last. ``df`` should be a table, as every round reads it.
    """
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)))
    cut, above, at = _narrow(df.select(key.alias("k")), n, largest=True)
    if cut is None:
        return df
    kept, tied, left = df.where(key > cut), df.where(key == cut), n - above
    if at <= left:
        return kept.unionByName(tied)
    digits = 0
    while tie and at > RANKED:
        digit = F.conv(F.hex(F.rpad(F.substring(F.encode(F.coalesce(tie, F.lit("")), "utf-8"), 7 * digits + 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("long")
        least, before, same = _narrow(tied.select(digit.alias("k")), left, largest=False)
        kept, left = kept.unionByName(tied.where(digit < least)), left - before
        tied = tied.where(digit == least)
        if same <= left:
            return kept.unionByName(tied)
        digits += 1
        longest = tied.agg(F.max(F.octet_length(tie)).alias("n")).first()["n"] or 0  # one number
        if same > RANKED and 7 * digits >= longest:
            return kept.unionByName(tied.limit(left))  # equal in order and tie: any will do
        at = same
    return kept.unionByName(tied.orderBy(*([F.col(tie)] if tie else [])).limit(left))


def _narrow(keys: DataFrame, n: int, largest: bool) -> tuple[int | None, int, int]:
    """The ``n``-th largest (or smallest) of the longs ``k``, how many lie beyond it and how many are equal; None if there are fewer."""
    ends = keys.agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n")).first()  # three numbers
    if ends["n"] <= n:
        return None, 0, 0
    low, high, beyond = ends["low"], ends["high"], 0
    while True:
        width = -(-(high - low + 1) // PARTS)
        kind = "bigint" if high - low < 2**62 else "decimal(38,0)"  # a wider difference has no place in a long
        place = F.expr(f"(CAST(k AS {kind}) - CAST('{low}' AS {kind})) DIV CAST('{width}' AS {kind})")
        got = keys.where(F.col("k").between(low, high)).groupBy(place.cast("long").alias("part")).agg(F.count("*").alias("n")).collect()  # PARTS rows at most
        for r in sorted(got, key=lambda r: r["part"], reverse=largest):
            if beyond + r["n"] >= n:
                low, high, here = low + r["part"] * width, min(high, low + (r["part"] + 1) * width - 1), r["n"]
                break
            beyond += r["n"]
        if low == high:
            return low, beyond, here
