"""Keyed rollups.  Every first/last rule names ``seq``; every one combines on the map side.

Sets that can grow without bound (parameter names and origins of an endpoint, URLs of a
client flow, technologies of a host) are child tables with one row per member instead of
arrays, so no group is ever collected into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import urls
from sightline.functions.text import blank, mask, nz, ordinal, short_content_type
from sightline.operators import filters
from sightline.schemas import SEVERITIES

SOURCES = ["proxy", "sitemap", "manual", "js", "spec", "graphql"]


def endpoint_events(prepared: DataFrame) -> DataFrame:
    """One row per exchange in the shape of an endpoint observation."""
    return prepared.select(
        "seq", "observed_at", F.col("method").alias("method"), nz(F.col("host")).alias("host"),
        F.col("ep_path").alias("path"), F.col("nurl").alias("normalized_url"), F.col("st").alias("status"),
        F.col("ct").alias("content_type"), "source", "authed",
    )


def endpoint_param_events(prepared: DataFrame) -> DataFrame:
    return prepared.select(
        "method", F.col("nurl").alias("normalized_url"), F.explode(F.array_distinct(F.transform("params", lambda p: p["name"]))).alias("name")
    ).where(F.col("name").isNotNull())


def endpoints(events: DataFrame) -> DataFrame:
    """Rollup of endpoint observations.

    ``first_order`` and the two ``*_order`` columns keep what decided each first/last-wins
    column, so that rollups of parts can be merged (``merge_endpoints``).
    """
    answered = F.col("status") > 0
    typed = ~blank(F.col("content_type"))
    return events.groupBy("method", "normalized_url").agg(
        F.min_by("host", "seq").alias("host"),
        F.min_by("path", "seq").alias("path"),
        F.count("*").alias("observations"),
        F.max(F.when(answered, F.struct("seq", "status"))).alias("_st"),
        F.max(F.when(typed, F.struct("seq", "content_type"))).alias("_ct"),
        *[F.max(F.when(F.col("source") == s, True)).alias(f"_s_{s}") for s in SOURCES],
        F.coalesce(F.bool_or("authed"), F.lit(False)).alias("auth_observed"),
        F.coalesce(F.bool_or(~F.col("authed")), F.lit(False)).alias("anon_observed"),
        F.min("observed_at").alias("first_seen"),
        F.min("seq").alias("first_seq"),
    ).select(
        "method", "normalized_url", "host", "path", "observations",
        F.coalesce("_st.status", F.lit(0)).alias("last_status"),
        nz(F.col("_ct.content_type")).alias("content_type"),
        F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_s_{s}"), F.lit(s)) for s in SOURCES]))).alias("sources"),
        "auth_observed", "anon_observed", auth_status(F.col("auth_observed"), F.col("anon_observed")).alias("auth_status"),
        "first_seen", "first_seq",
        F.col("_st.seq").alias("status_seq"), F.col("_ct.seq").alias("content_type_seq"),
    )


def auth_status(auth: Column, anon: Column) -> Column:
    return (
        F.when(auth & anon, F.lit("both")).when(auth, F.lit("auth")).when(anon, F.lit("anon")).otherwise(F.lit(""))
    )


def merge_endpoints(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rollup of two rollups: the same result as one rollup of all observations."""
    return merge_parts(a.unionByName(b))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Rollup of any number of rollups in one table."""
    return parts.groupBy("method", "normalized_url").agg(
        F.min_by("host", "first_seq").alias("host"),
        F.min_by("path", "first_seq").alias("path"),
        F.sum("observations").alias("observations"),
        F.max(F.when(F.col("status_seq").isNotNull(), F.struct("status_seq", "last_status"))).alias("_st"),
        F.max(F.when(F.col("content_type_seq").isNotNull(), F.struct("content_type_seq", "content_type"))).alias("_ct"),
        *[F.bool_or(F.array_contains("sources", s)).alias(f"_s_{s}") for s in SOURCES],
        F.bool_or("auth_observed").alias("auth_observed"),
        F.bool_or("anon_observed").alias("anon_observed"),
        F.min("first_seen").alias("first_seen"),
        F.min("first_seq").alias("first_seq"),
    ).select(
        "method", "normalized_url", "host", "path", "observations",
        F.coalesce("_st.last_status", F.lit(0)).alias("last_status"),
        nz(F.col("_ct.content_type")).alias("content_type"),
        F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_s_{s}"), F.lit(s)) for s in SOURCES]))).alias("sources"),
        "auth_observed", "anon_observed", auth_status(F.col("auth_observed"), F.col("anon_observed")).alias("auth_status"),
        "first_seen", "first_seq", F.col("_st.status_seq").alias("status_seq"), F.col("_ct.content_type_seq").alias("content_type_seq"),
    )


def parameter_events(prepared: DataFrame) -> DataFrame:
    """Request parameters by location; XML ones are dropped."""
    body = F.when(F.col("has_resp"), F.col("body")).otherwise(F.lit(""))
    p = F.col("p")
    loc = (
        F.when(p["location"] == "URL", F.lit("QUERY"))
        .when(p["location"] == "MULTIPART_ATTRIBUTE", F.lit("BODY"))
        .otherwise(p["location"])
    )
    rows = prepared.select("seq", "nurl", "ep_path", "body", "has_resp", F.posexplode("params").alias("pos", "p"))
    return rows.select(
        "seq", "pos", F.col("nurl").alias("endpoint_key"), F.col("ep_path").alias("endpoint_path"), loc.alias("location"),
        p["name"].alias("name"), p["value"].alias("value"),
        ((F.length(nz(p["value"])) >= 4) & body.contains(nz(p["value"]))).alias("reflected"),
    ).where(F.col("location").isin("QUERY", "BODY", "COOKIE", "JSON", "HEADER"))


def parameter_parts(events: DataFrame) -> DataFrame:
    """Partial rollup of parameter observations: mergeable, as first/last rules keep their ``seq`` and ``pos``."""
    example = F.when(~blank(F.col("value")), F.struct("seq", "pos", "value"))
    return events.groupBy("endpoint_key", "location", "name").agg(
        F.min(F.struct("seq", "pos", "endpoint_path")).alias("first"),
        F.min(example).alias("example"),
        F.bool_or("reflected").alias("reflected"),
        F.count("*").alias("seen"),
    ).withColumn("host", urls.host_of(F.col("endpoint_key")))


def merge_parameter_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("endpoint_key", "location", "name").agg(
        F.min("first").alias("first"), F.min("example").alias("example"), F.bool_or("reflected").alias("reflected"), F.sum("seen").alias("seen"),
    ).withColumn("host", urls.host_of(F.col("endpoint_key")))


def finished_parameters(parts: DataFrame) -> DataFrame:
    return parts.select(
        "endpoint_key", "location", "name", F.col("first.endpoint_path").alias("endpoint_path"), "host",
        nz(F.col("example.value")).alias("example"), "reflected", "seen", F.col("first.seq").alias("first_seq"),
    )


def parameters(events: DataFrame) -> DataFrame:
    return finished_parameters(parameter_parts(events))


def finding_parts(events: DataFrame) -> DataFrame:
    """Partial rollup of finding events: the first occurrence and the count."""
    return events.groupBy("type", "raw_match").agg(
        F.min(F.struct("seq", "ord", "severity", "location", "evidence", "sensitive")).alias("f"), F.count("*").alias("times_seen"),
    ).withColumn("host", urls.host_of(F.col("f.location")))


def merge_finding_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("type", "raw_match").agg(F.min("f").alias("f"), F.sum("times_seen").alias("times_seen")).withColumn("host", urls.host_of(F.col("f.location")))


def finished_findings(parts: DataFrame) -> DataFrame:
    """``raw_match`` is kept for joins only and leaves through ``masked``."""
    return parts.select(
        "type", "raw_match", F.col("f.severity").alias("severity"), F.col("f.location").alias("location"),
        F.col("f.evidence").alias("evidence"), F.col("f.sensitive").alias("sensitive"), "times_seen",
        F.when(F.col("f.sensitive"), mask(F.col("raw_match"))).otherwise(F.lit("")).alias("masked"),
        "host", F.col("f.seq").alias("first_seq"),
    )


def findings(events: DataFrame) -> DataFrame:
    """First occurrence wins, occurrences are counted."""
    return finished_findings(finding_parts(events))


def finding_is_new(events: DataFrame) -> DataFrame:
    """Marks the first occurrence of each finding.

    The join key contains ``seq`` and ``ord``, so it is unique: a finding that makes up a
    third of all events spreads over all tasks, which a window over the key would not.
    """
    first = events.groupBy("type", "raw_match").agg(F.min(F.struct("seq", "ord")).alias("f")).select(
        "type", "raw_match", F.col("f.seq").alias("seq"), F.col("f.ord").alias("ord"), F.lit(True).alias("is_new")
    )
    return events.join(first, ["type", "raw_match", "seq", "ord"], "left").withColumn(
        "is_new", F.coalesce("is_new", F.lit(False))
    )


def tech_rows(prepared: DataFrame) -> DataFrame:
    """Distinct (host, technology)."""
    from sightline.operators.detect import technologies

    return prepared.select("host", F.explode(technologies()).alias("technology")).distinct()


def tech_missing(prepared: DataFrame) -> DataFrame:
    """Per host: missing headers of its latest HTML response; NULL where it sent none."""
    from sightline.operators.detect import missing_header_names

    seen = prepared.where(F.col("has_resp") & ~blank(F.col("host")))
    return seen.groupBy("host").agg(
        F.max(F.when(F.col("is_html"), F.struct("seq", missing_header_names().alias("missing")))).alias("m")
    ).select("host", F.coalesce("m.missing", F.array().cast("array<string>")).alias("missing_headers"))


def tech(prepared: DataFrame) -> DataFrame:
    """One row per host: number of technologies and missing headers."""
    n = tech_rows(prepared).groupBy("host").agg(F.count("*").alias("technologies"))
    return tech_missing(prepared).join(n, "host", "left").select(
        "host", F.coalesce("technologies", F.lit(0)).alias("technologies"), "missing_headers"
    )


def tech_report(prepared: DataFrame) -> DataFrame:
    """One row per host as a report shows it: the technologies it was seen with and its missing headers, both sorted.

    One pass over the capture. Labels are those of a fixed list but for the versions and generator names
    in them, and only distinct ones meet in the row of a host.
    """
    from sightline.operators.detect import missing_header_names, technologies

    seen = prepared.where(F.col("has_resp") & ~blank(F.col("host")))
    each = seen.select(
        "host", F.explode_outer(technologies()).alias("technology"), F.when(F.col("is_html"), F.struct("seq", missing_header_names().alias("missing"))).alias("m")
    )
    distinct = each.groupBy("host", "technology").agg(F.max("m").alias("m"))
    return distinct.groupBy("host").agg(F.array_sort(F.collect_set("technology")).alias("technologies"), F.max("m").alias("m")).select(
        "host", "technologies", F.array_sort(F.coalesce("m.missing", F.array().cast("array<string>"))).alias("missing_headers")
    )


def counters(prepared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    by_status = prepared.where(F.col("st") > 0).groupBy(F.col("st").alias("status")).agg(F.count("*").alias("n"))
    by_host = prepared.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"))
    by_type = prepared.where(~blank(F.col("ct"))).groupBy(short_content_type(F.col("ct")).alias("content_type")).agg(
        F.count("*").alias("n")
    )
    return by_status, by_host, by_type


def annotations(log: DataFrame) -> DataFrame:
    """Latest entry per key of an annotation log (key, bookmarked, note, triage, ts).

    Entries with neither bookmark nor note are dropped unless triage was set.
    """
    last = log.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct("ts", "bookmarked", "note", "triage")).alias("a"))
    out = last.select(
        "key", F.coalesce("a.bookmarked", F.lit(False)).alias("bookmarked"), nz(F.col("a.note")).alias("note"),
        F.coalesce("a.triage", F.lit("NEW")).alias("triage"),
    )
    return out.where(F.col("bookmarked") | (F.col("note") != "") | (F.col("triage") != "NEW"))


def host_schemes(eps: DataFrame) -> DataFrame:
    """Scheme per lower-cased host: that of its first endpoint in (host, path) order."""
    scheme = F.when(F.col("normalized_url").startswith("http://"), "http").when(
        F.col("normalized_url").startswith("https://"), "https"
    )
    rows = eps.select("host", "path", "method", "normalized_url", scheme.alias("scheme")).where(F.col("scheme").isNotNull())
    return rows.groupBy(F.lower("host").alias("host")).agg(
        F.min(F.struct("host", "path", "normalized_url", "method", "scheme")).alias("m")
    ).select("host", F.col("m.scheme").alias("scheme"))


def severity_order(df: DataFrame) -> DataFrame:
    return df.orderBy(ordinal(F.col("severity"), SEVERITIES), "type", "raw_match")


def retained(df: DataFrame, cap: int) -> DataFrame:
    return filters.newest(df, cap)
