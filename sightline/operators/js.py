"""JavaScript files: one row per distinct body, then what the flat rules say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.config import Settings
from sightline.functions import urls
from sightline.functions.text import blank, cut, first_match, nz, rl
from sightline.operators import detect
from sightline.operators.detect import finding, note
from sightline.rules import js_packs as jp
from sightline.rules import packs
from sightline.session import shuffled


def js_responses(prepared: DataFrame) -> DataFrame:
    """seq, url, body of JavaScript responses."""
    return prepared.where(F.col("has_resp") & F.col("is_js")).select("seq", "url", "body")


def kind_of(host: Column, file: Column, head: Column, size: Column) -> Column:
    """Library, vendor or third-party label; empty for app code."""
    filled = size > 0

    def label(kind: str, text: str, value: Column | None):
        pre = {"library": "Library: ", "third-party": "3rd-party: ", "vendor": ""}[kind]
        if "$1" in text and value is not None:
            return F.concat(F.lit(pre), F.trim(F.concat(F.lit(text.split("$1")[0]), value)))
        text = text.replace("$1", "").strip()
        return F.lit(pre + text if kind != "vendor" or text else "Vendor chunk")

    pairs = []
    for kind, text, part, rx in jp.LIBRARIES:
        col = {"host": host, "file": file, "banner": head}[part]
        cond = rl(col, "(?i)" + rx) & (col != "")
        if part == "banner":
            pairs.append((filled & cond, label(kind, text, F.regexp_extract(head, "(?i)" + rx, 1) if "(" in rx and "$1" in text else None)))
        else:
            pairs.append((cond, label(kind, text, None)))
    return first_match(pairs, "")


def distinct_bodies(js: DataFrame) -> DataFrame:
    """One row per body hash: the first URL wins.

    Each body is hashed once, and one aggregate keeps a single copy of it per task and
    hash before the shuffle, however often it was served.
    """
    rows = js.where(~blank(F.col("body"))).withColumn("sha256", F.sha2("body", 256))
    one = rows.groupBy("sha256").agg(F.min(F.struct("seq", "url")).alias("m"), F.count("*").alias("served"), F.first("body").alias("body"))
    return one.select("sha256", "m.seq", "served", "m.url", "body")


def with_kind(bodies: DataFrame, settings: Settings = Settings()) -> DataFrame:
    # Columns of their own: the rule chain reads each of them many times.
    df = bodies.select(
        "*", F.lower(urls.host_of(F.col("url"))).alias("_host"), urls.file_part(F.col("url")).alias("_file"),
        F.left("body", F.lit(jp.BANNER_SCAN)).alias("_head"), F.length("body").alias("size"),
    )
    df = df.select("*", kind_of(F.col("_host"), F.col("_file"), F.col("_head"), F.col("size")).alias("kind"))
    df = df.drop("_host", "_file", "_head")
    return df.withColumn("deep", F.lit(settings.analyze_library_js) | (F.col("kind") == ""))


def link_array(body: Column) -> Column:
    """Distinct links in rule order, then text order."""
    hits = [
        F.regexp_extract_all(body, F.lit(rx), F.lit(1)) for _, rx in jp.LINK_RULES
    ]
    links = F.array_distinct(F.transform(F.concat(*hits), lambda s: F.trim(s)))
    return F.filter(
        links,
        lambda s: (F.length(s) >= 3)
        & ~(s.contains("${") | s.contains("{{") | s.contains("<%"))
        & ~s.rlike(jp.MIME_LIKE)
        & (s.startswith("/") | s.startswith("http") | s.contains("/")),
    )


def links(assets: DataFrame) -> DataFrame:
    """sha256, seq, js_url, pos, link of app JavaScript."""
    return assets.where("deep").select(
        "sha256", "seq", F.col("url").alias("js_url"), F.posexplode(link_array(F.col("body"))).alias("pos", "link")
    )


def link_endpoint_events(ln: DataFrame) -> DataFrame:
    own = urls.host_of(F.col("js_url"))
    host = F.when(F.col("link").startswith("http"), urls.host_of(F.col("link"))).otherwise(own)
    return ln.select(
        "seq", F.lit(None).cast("timestamp").alias("observed_at"), F.lit("JS").alias("method"), host.alias("host"),
        F.col("link").alias("path"), F.col("link").alias("normalized_url"), F.lit(0).alias("status"),
        F.lit("").alias("content_type"), F.lit("js").alias("source"), F.lit(None).cast("boolean").alias("authed"),
    )


def link_origins(ln: DataFrame) -> DataFrame:
    """Distinct (link endpoint, JavaScript file)."""
    return ln.select(F.lit("JS").alias("method"), F.col("link").alias("normalized_url"), "js_url").distinct()


def route_findings(ln: DataFrame) -> DataFrame:
    """First matching family per link."""
    r = ln.withColumn("route", urls.route_path(F.col("link")))
    r = r.withColumn("rule", detect.route_rule(F.col("route"))).where(F.col("rule").isNotNull())
    sev = first_match([(F.col("rule") == x.name, x.severity) for x in jp.ROUTES])
    hint = first_match([(F.col("rule") == x.name, note(x.note)) for x in jp.ROUTES])
    f = finding(F.col("rule"), sev, F.col("link"), F.col("js_url"), F.concat(F.lit("route referenced in JS"), hint))
    return r.select("seq", (F.lit(3_000_000) + F.col("pos")).alias("ord"), f.alias("f")).select("seq", "ord", "f.*")


def param_array(body: Column) -> Column:
    hits = F.concat(*[F.regexp_extract_all(body, F.lit(rx), F.lit(1)) for _, rx in jp.PARAM_RULES])
    return F.array_distinct(F.filter(hits, lambda n: F.length(n) >= 2))


def hidden_params(assets: DataFrame) -> DataFrame:
    """sha256, seq, js_url, pos, name, interesting."""
    rows = assets.where("deep").select("sha256", "seq", F.col("url").alias("js_url"), F.posexplode(param_array(F.col("body"))).alias("pos", "name"))
    return rows.withColumn("interesting", rl(F.col("name"), jp.PARAM_INTERESTING))


def param_findings(hp: DataFrame) -> DataFrame:
    r = hp.where("interesting")
    f = finding(
        F.concat(F.lit(jp.HIDDEN_PARAM_PREFIX), F.col("name")), "LOW", F.col("name"), F.col("js_url"),
        "parameter referenced in JS" + note("confirm how the endpoints that take it treat it"),
    )
    return r.select("seq", (F.lit(4_000_000) + F.col("pos")).alias("ord"), f.alias("f")).select("seq", "ord", "f.*")


def js_param_names(hp: DataFrame) -> DataFrame:
    """First JavaScript file of each name."""
    return hp.groupBy("name").agg(F.min(F.struct("seq", "pos", "js_url")).alias("m")).select("name", F.col("m.js_url").alias("js_url"))


def body_findings(assets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Secrets and source maps of every distinct body; lead rules and comments of app code."""
    url, body = F.col("url"), F.col("body")
    arrays = []
    if settings.scan_secrets:
        arrays.append(detect.scan_rules("body", packs.SECRETS))
    arrays.append(detect.sourcemap_refs(body, url))
    deep = [detect.scan_rules("body", jp.LEAD_RULES, sensitive=False)]
    if settings.run_passive_checks:
        deep.append(detect.js_comments(body, url))
    arrays.append(detect.gate(F.col("deep"), F.concat(*deep)))
    out = detect.explode_findings(assets, *arrays)
    return out.withColumn("ord", F.col("ord") + 5_000_000)


def snippet(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _note_of(rule):
    return lambda m: F.concat(F.lit(rule.name + ": "), snippet(m), F.lit(note(rule.note)))


def flat_notes(assets: DataFrame) -> DataFrame:
    """sha256, ord, note: matches of the locator rules in app JavaScript."""
    arrays = []
    for r in jp.NOTE_RULES:
        found = F.regexp_extract_all("body", F.lit(r.regex), F.lit(0))
        arrays.append(F.transform(found, _note_of(r)))
    rows = assets.where("deep").select("sha256", F.posexplode(F.array_distinct(F.concat(*arrays))).alias("pos", "note"))
    return rows.select("sha256", (F.col("pos") + 1_000_000).alias("ord"), "note")


PREVIEW_MAX = 160


def code_snippet(body: Column) -> Column:
    """Start of the code without a leading banner comment and "use strict"."""
    head = F.left(body, F.lit(8192))
    h = F.regexp_replace(head, r"(?s)\A\s*/\*.*?(?:\*/|\z)", "")
    h = F.regexp_replace(h, r"\A\s*//[^\n]*(?:\n|\z)", "")
    h = F.regexp_replace(h, r"""\A\s*(?:"use strict";|'use strict';)""", "")
    return cut(F.trim(F.regexp_replace(h, r"\s+", " ")), PREVIEW_MAX)


def preview(link_arr: Column, body: Column) -> Column:
    """Up to three links (API paths first, then absolute paths, then the rest), else code."""
    api = F.filter(link_arr, lambda s: s.contains("/api"))
    rooted = F.filter(link_arr, lambda s: s.startswith("/"))
    picked = F.slice(F.array_distinct(F.concat(api, rooted, link_arr)), 1, 3)
    return F.when(F.size(picked) > 0, cut(F.array_join(picked, ", "), PREVIEW_MAX)).otherwise(code_snippet(body))


def assets(bodies: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """JavaScript file records: one row per distinct body."""
    df = with_kind(bodies, settings)
    none = F.array().cast("array<string>")
    df = df.withColumn("links", F.when(F.col("deep"), link_array(F.col("body"))).otherwise(none))
    secrets = F.size(detect.scan_rules("body", packs.SECRETS)) if settings.scan_secrets else F.lit(0)
    return df.select(
        "sha256", "seq", "url", urls.host_of(F.col("url")).alias("host"), "size", "kind", "served",
        F.size("links").alias("endpoint_count"), secrets.alias("secret_count"), preview(F.col("links"), F.col("body")).alias("preview"),
    )


def body_store(bodies: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Bodies still to be written: host, file_name, sha256, body."""
    df = bodies if stored is None else bodies.join(shuffled(stored.select("sha256")), "sha256", "left_anti")
    return df.select(
        urls.host_of(F.col("url")).alias("host"), urls.stored_file_name(F.col("url"), F.col("sha256")).alias("file_name"), "sha256", "body"
    )


def rebuild_candidates(stored: DataFrame, assets_df: DataFrame, noted: DataFrame) -> DataFrame:
    """Stored bodies to analyse again: the hash still matches and there are no notes yet."""
    ok = stored.where(F.sha2("body", 256) == F.col("sha256")).select("sha256", "body")
    todo = assets_df.join(shuffled(noted.select("sha256").distinct()), "sha256", "left_anti").select("sha256", "seq", "url", "kind")
    return todo.join(shuffled(ok), "sha256")


def js_sourced(findings: DataFrame, assets_df: DataFrame) -> DataFrame:
    """Findings whose location is a known JavaScript URL."""
    return findings.join(shuffled(assets_df.select(F.col("url").alias("location")).distinct()), "location", "left_semi")


def nonlibrary(findings: DataFrame, assets_df: DataFrame) -> DataFrame:
    libs = assets_df.where(nz(F.col("kind")) != "").select(F.col("url").alias("location")).distinct()
    return findings.join(shuffled(libs), "location", "left_anti")
