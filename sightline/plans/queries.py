"""Named queries over the driver's tables: one per operator."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import checks, classify, headers, text, urls
from sightline.operators import (
    detect, diff, filters, js, json_fields, jwt, marts, params, replay, rollup, search, sessions, specs,
)
from sightline.plans.inventory import Inventory, Share, together, triaged
from sightline.rules import js_packs, packs
from sightline.rules.packs import Rule
from sightline.session import contents, persist_table, shuffled
from sightline.sources import adapters, readers, sinks

NET = ("events", "pages", "documents")
QUERIES: dict[str, object] = {}
C = F.col


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def ex(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    return adapters.capture(spark, sf, *(parts or NET))


@lru_cache(maxsize=64)
def _prep(spark, app, sf, parts, files) -> DataFrame:
    return detect.prepare(ex(spark, sf, *parts))


@lru_cache(maxsize=64)
def _inv(spark, app, sf, parts, files) -> Inventory:
    return Inventory(ex(spark, sf, *parts))


def _inputs(spark, sf) -> tuple:
    """What the input holds now; a kept plan or inventory is used again only for the same files."""
    return contents(spark, *(f"{sf}/{name}.parquet" for name in NET))


def prep(spark, sf, *parts) -> DataFrame:
    """The analysed plan is kept between queries; no data is."""
    return _prep(spark, spark.sparkContext.applicationId, sf, parts, _inputs(spark, sf))


def inv(spark, sf, *parts) -> Inventory:
    """The tables that an inventory has written are kept between queries over the same files."""
    return _inv(spark, spark.sparkContext.applicationId, sf, parts, _inputs(spark, sf))


def forget() -> None:
    """Let the next queries analyse their input anew."""
    _prep.cache_clear()
    _inv.cache_clear()


def joined(c, sep="|"):
    return F.array_join(c, sep)


def ev_out(ev: DataFrame) -> DataFrame:
    """Finding events without the raw match."""
    return ev.select(
        "seq", "type", "severity", F.sha2(F.concat(C("type"), F.lit("|"), C("raw_match")), 256).alias("fingerprint"), "location",
    )


def fi_out(f: DataFrame) -> DataFrame:
    return f.select("type", "severity", "masked", F.sha2(diff.finding_key(), 256).alias("fingerprint"), "location", "host", "times_seen", "first_seq")


def ep_out(e: DataFrame) -> DataFrame:
    return e.select(
        "method", "normalized_url", "host", "path", "observations", "last_status", "content_type", joined(C("sources")).alias("sources"),
        "auth_status", "first_seq",
    )


def nv(headers_col):
    return F.array_join(F.transform(headers_col, lambda h: F.concat(h["name"], F.lit("="), text.nz(h["value"]))), "|")


def detector(name: str, parts, *fns):
    def run(spark, sf):
        return ev_out(detect.explode_findings(prep(spark, sf, *parts), *[f() for f in fns]))

    run.__name__ = name
    return query(run)


EV, PG, DOC = ("events",), ("pages",), ("documents",)
detector("secret_scan", NET, detect.secret_scan)
detector("signature_scan", NET, detect.signature_scan)
detector("authz_scan", NET, detect.authz_scan)
detector("pii_card", NET, detect.pii_card)
detector("pii_phone", NET, detect.pii_phone)
detector("pii_rrn", NET, detect.pii_rrn)
detector("cors_findings", EV, detect.cors)
detector("cookie_findings", EV, detect.cookie_flags)
detector("csp_findings", EV, detect.csp)
detector("cacheable_findings", EV, detect.cacheable)
detector("missing_headers", NET, detect.missing_headers)
detector("exposed_files", NET, detect.exposed_files)
detector("mixed_content", NET, detect.mixed_content)
detector("unauth_access", NET, detect.unauth_access)
detector("csrf_candidates", EV, detect.csrf)
detector("upload_endpoints", EV, detect.upload)
detector("auth_flows", NET, detect.auth_flow)
detector("mass_assignment", EV, detect.mass_assignment)
detector("sensitive_fields", EV, detect.sensitive_fields)
detector("html_comments", NET, detect.html_comments)
detector("sourcemap_exposed", ("specs", "scripts"), detect.sourcemap_exposed)


def _param_lead(name: str, ftype: str):
    def run(spark, sf):
        return ev_out(detect.explode_findings(prep(spark, sf), detect.param_leads()).where(C("type") == ftype))

    run.__name__ = name
    return query(run)


_param_lead("secret_in_url", "Secret in URL")
_param_lead("open_redirect", "Open redirect (candidate)")
_param_lead("reflected_params", "Reflected param (XSS?)")

USER_RULES = [Rule("Order path", "LOW", r"\bsku-[0-9]{1,4}\b"), Rule("Trailing boom", "MEDIUM", r"boom [0-9]")]


# --- sources ----------------------------------------------------------------------------


@query
def src_exchanges(spark, sf):
    scoped = filters.scope(ex(spark, sf), r"^https?://", r"docs\.example/fr/")
    return scoped.select("seq", "source", "method", "url", "host", "path", "status", "content_type", F.length("resp_body").cast("bigint").alias("size"))


@query
def src_manual(spark, sf):
    base = ex(spark, sf, "pages")
    scoped = filters.scope(base, r"/en/")
    out = readers.with_manual(scoped, ex(spark, sf, "documents"))
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


@query
def src_js_files(spark, sf):
    """Files imported beside a capture: a body that was captured already adds nothing."""
    captured = js.js_responses(prep(spark, sf, "scripts"))
    local = F.when(C("seq") % 8 == 3, F.concat("body", F.lit("\n// local copy"))).otherwise(C("body"))
    files = captured.select((C("seq") + F.lit(1_000_000_000_000)).alias("seq"), F.concat(F.lit("import://"), urls.file_part(C("url"))).alias("url"), local.alias("body"))
    b = js.distinct_bodies(captured.unionByName(files))
    return b.select("sha256", "url", C("url").startswith("import://").alias("imported"), "served")


@query
def src_rules(spark, sf):
    """Rules of a pack that load, with their hits on document texts."""
    import json

    pack = {"patterns": [
        {"name": "mail", "severity": "low", "regex": r"[a-z0-9.]{1,40}@[a-z0-9.]{1,60}"},
        {"name": "bad", "severity": "LOW", "regex": "("},
        {"name": "loop", "severity": "LOW", "regex": "(a+)+b"},
        {"name": "ip", "regex": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"},
    ]}
    rules, errors = readers.load_rules(spark, json.dumps(pack))
    ev = detect.explode_findings(prep(spark, sf, "documents"), detect.user_rules(rules))
    return ev.groupBy("type", "severity").agg(F.count("*").alias("hits")).withColumn("rejected", F.lit(len(errors)).cast("bigint"))


@query
def user_rule_scan(spark, sf):
    return ev_out(detect.explode_findings(prep(spark, sf), detect.user_rules(USER_RULES)))


@F.pandas_udf(T.BinaryType())
def _deflate(texts, kinds):
    import gzip
    import zlib

    import pandas as pd

    out = []
    for t, k in zip(texts, kinds):
        b = t.encode("utf-8")
        out.append(gzip.compress(b) if k == "gzip" else zlib.compress(b) if k == "deflate" else b)
    return pd.Series(out)


@query
def normalise_bodies(spark, sf):
    d = adapters.spread(adapters.read_table(spark, sf, "documents"))
    kind = F.when(C("doc_id") % 3 == 0, "gzip").when(C("doc_id") % 3 == 1, "deflate").otherwise("")
    raw = d.select("doc_id", kind.alias("content_encoding"), F.lit("text/plain; charset=utf-8").alias("content_type"), "text")
    raw = raw.select("doc_id", "content_encoding", "content_type", _deflate("text", "content_encoding").alias("raw_body"))
    out = readers.normalise_bodies(raw)
    return out.select("doc_id", "content_encoding", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("bigint").alias("n_chars"))


@query
def js_rebuild(spark, sf):
    i = inv(spark, sf, "scripts")
    stored = i.bodies.select("sha256", F.when(C("seq") % 5 == 0, F.concat("body", F.lit(" "))).otherwise(C("body")).alias("body"))
    noted = i.bodies.where(C("seq") % 7 == 0)
    return js.rebuild_candidates(stored, i.assets, noted).select("sha256", "url", "kind")


# --- filters -----------------------------------------------------------------------------


@query
def scope_filter(spark, sf):
    hosts = ex(spark, sf, "pages").select("host").distinct()
    base = ex(spark, sf).select("seq", "url", "host")
    return filters.scope(base, r"/(?:en|fr)/", r"[?&]page=", hosts=hosts).select("seq", "url")


@query
def static_filter(spark, sf):
    e = ex(spark, sf, "events", "pages").select("seq", "url", "content_type")
    return e.where(~filters.is_static_asset(C("url"), C("content_type"))).select("seq", "url")


@query
def is_js(spark, sf):
    e = ex(spark, sf, "events", "scripts", "specs").select("url", "content_type")
    return e.groupBy(filters.is_javascript(C("url"), C("content_type")).alias("js"), "content_type").agg(F.count("*").alias("n"))


@query
def content_kind(spark, sf):
    e = ex(spark, sf, "events", "pages", "specs").select("seq", "content_type")
    ct = C("content_type")
    return e.select("seq", filters.is_html(ct).alias("html"), filters.is_json(ct).alias("json"), filters.is_api(ct).alias("api"))


@query
def search_rows(spark, sf):
    d = adapters.read_table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return filters.search(d, filters.all_columns(d), "src1 THE -de").select("doc_id")


@query
def search_field(spark, sf):
    d = adapters.read_table(spark, sf, "pages").select("page_id", "url")
    return filters.search(d, C("url"), r"/en/\d+ -page=\d example\.(?:com|org)", regex=True)


@query
def search_body(spark, sf):
    d = adapters.read_table(spark, sf, "pages")
    return filters.search(d, C("html"), "nav THAT -cheap", case_sensitive=False).select("page_id")


@query
def value_filter(spark, sf):
    e = ex(spark, sf, "events").select("seq", "content_type")
    return filters.value_filter(e, "content_type", ["text/plain", "text/html"])


@query
def value_options(spark, sf):
    return filters.value_options(ex(spark, sf), "content_type")


@query
def finding_visible(spark, sf):
    f = classify.with_category(inv(spark, sf, "events", "pages").findings)
    return filters.finding_visible(f, "LOW", ["Comment", "Misconfig"]).select("type", "severity", "category", "masked", "location")


@query
def host_focus(spark, sf):
    i = inv(spark, sf, "events")
    return filters.host_focus(i.endpoints, "API.shop.example").select("method", "normalized_url", "observations")


def _annotation_log(f: DataFrame) -> DataFrame:
    """Analyst entries derived from findings: two per finding, the later one counts."""
    h = F.conv(F.substring(F.sha2(diff.finding_key(), 256), 1, 4), 16, 10).cast("bigint")
    base = f.select(diff.finding_key().alias("key"), h.alias("h"))
    late = base.select(
        "key", F.lit(2).alias("ts"), (C("h") % 4 == 0).alias("bookmarked"), F.when(C("h") % 5 == 0, "look").otherwise("").alias("note"),
        F.when(C("h") % 7 == 0, "CONFIRMED").when(C("h") % 7 == 1, "FALSE_POSITIVE").otherwise("NEW").alias("triage"),
    )
    early = base.select("key", F.lit(1).alias("ts"), F.lit(True).alias("bookmarked"), F.lit("old").alias("note"), F.lit("REVIEWED").alias("triage"))
    return late.where(C("key").isNotNull()).unionByName(early)


@query
def annotations(spark, sf):
    a = rollup.annotations(_annotation_log(inv(spark, sf, "events").findings))
    return a.select(F.sha2("key", 256).alias("key_sha"), "bookmarked", "note", "triage")


@query
def annotated_rows(spark, sf):
    f = inv(spark, sf, "events").findings
    t = triaged(f, rollup.annotations(_annotation_log(f)))
    return t.groupBy("triage", "bookmarked", "note").agg(F.count("*").alias("n"), F.sum("times_seen").alias("seen"))


@query
def report_filter(spark, sf):
    f = inv(spark, sf, "events").findings
    a = rollup.annotations(_annotation_log(f))
    t = triaged(f, a)
    return filters.report_filter(t, a, exclude_false_positive=True, bookmarked_only=True).select("type", "severity", "masked", "times_seen", "triage")


@query
def retention_cap(spark, sf):
    e = inv(spark, sf).endpoints.select("method", "normalized_url", "first_seq")
    return filters.newest(e, 1000)


# --- scalars --------------------------------------------------------------------------------


@query
def host_of(spark, sf):
    return ex(spark, sf).select("seq", urls.host_of(C("url")).alias("host"))


@query
def host_label(spark, sf):
    return ex(spark, sf).select(urls.host_label(F.when(C("seq") % 7 == 0, " ").otherwise(C("host"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query
def normalized_url(spark, sf):
    return ex(spark, sf).select("seq", urls.normalized_url(C("url"), C("host"), C("path"), C("params")).alias("normalized_url"))


@query
def route_path(spark, sf):
    e = ex(spark, sf)
    link = F.when(C("seq") % 5 == 0, F.concat(C("url"), F.lit("/?x=1#top"))).when(C("seq") % 5 == 1, F.concat(F.lit("."), C("path"), F.lit("//")))
    link = link.when(C("seq") % 5 == 2, F.concat(F.lit("//"), C("host"), C("path"))).when(C("seq") % 5 == 3, F.substring(C("path"), 2, 500)).otherwise(C("url"))
    return e.select("seq", urls.route_path(link).alias("route"))


@query
def mask_value(spark, sf):
    """Every word of every whole text, masked."""
    d = adapters.read_table(spark, sf, "documents")
    words = F.transform(F.split(C("text"), " ", -1), text.mask)
    return d.select("doc_id", F.size(words).cast("bigint").alias("values"), F.sha2(F.array_join(words, " "), 256).alias("masked_sha"))


def _values(spark, sf):
    """Parameter values of many shapes, derived from rows."""
    e = adapters.read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    i, u = C("event_id"), C("user_id").cast("string")
    v = (
        F.when(i % 12 == 0, u).when(i % 12 == 1, F.concat(F.lit("88"), u, F.lit("13")))
        .when(i % 12 == 2, F.regexp_replace(F.md5(u), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
        .when(i % 12 == 3, F.concat(F.lit("https%3A%2F%2Fh"), u, F.lit(".example%2Fx"))).when(i % 12 == 4, F.concat(F.lit("//h"), u, F.lit(".example/x")))
        .when(i % 12 == 5, F.concat(F.lit("u"), u, F.lit("@mail.example"))).when(i % 12 == 6, F.concat(F.lit("/home/"), u))
        .when(i % 12 == 7, F.lit("rO0ABXQ=")).when(i % 12 == 8, F.concat(F.lit("a:"), u, F.lit(":{x}")))
        .when(i % 12 == 9, F.concat(F.substring(F.md5(u), 1, 20), F.lit("AbCd"))).when(i % 12 == 10, F.lit("eyJhbGciOiJ9.eyJzdWIiOiI.x")).otherwise(F.lit("hello…"))
    )
    name = F.element_at(
        F.array(*[F.lit(n) for n in ("user_id", "redirect_url", "file", "sort_by", "cmd", "session_token", "debug", "template", "title", "articleKey", "id", "next")]),
        (i % 12 + 1).cast("int"),
    )
    return e.select("event_id", name.alias("name"), v.alias("value"), F.concat(C("event_type"), u).alias("other"))


@query
def value_kind(spark, sf):
    return _values(spark, sf).select("event_id", classify.value_kind(C("value")).alias("kind"))


@query
def param_classes(spark, sf):
    v = _values(spark, sf)
    return v.select("event_id", joined(classify.name_classes(C("name"))).alias("classes"), joined(classify.name_classes(C("other"))).alias("other_classes"))


@query
def param_classes_full(spark, sf):
    v = _values(spark, sf).withColumn("kind", classify.value_kind(C("value")))
    return v.select("event_id", joined(classify.classes(C("name"), C("kind"))).alias("classes"))


@query
def finding_category(spark, sf):
    f = inv(spark, sf).findings.groupBy("type").agg(F.count("*").alias("n"))
    return classify.with_category(f)


@query
def finding_hint(spark, sf):
    f = inv(spark, sf, "events").findings
    return f.select("type", F.sha2(diff.finding_key(), 256).alias("fingerprint"), (classify.own_hint(C("evidence")) != "").alias("own"), classify.hint_for_type(C("type")).alias("hint"))


@query
def entropy(spark, sf):
    d = adapters.read_table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\s+", "").alias("v"))
    return d.select("doc_id", F.round(checks.shannon(C("v")), 6).alias("bits"))


@query
def card_check(spark, sf):
    e = adapters.read_table(spark, sf, "events")
    d = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("4539", "5105", "3711", "6011", "3601", "3530", "1234")]), (C("event_id") % 7 + 1).cast("int")),
                 F.substring(F.conv(F.substring(F.md5(C("event_id").cast("string")), 1, 14), 16, 10), 1, 8), F.lpad((C("event_id") % 10000).cast("string"), 4, "0"))
    return e.select("event_id", checks.plausible_card(d).alias("ok"))


@query
def rrn_check(spark, sf):
    e = adapters.read_table(spark, sf, "events")
    i = C("event_id")
    d = F.concat(F.lit("90"), F.lpad((i % 14).cast("string"), 2, "0"), F.lpad((i % 33).cast("string"), 2, "0"), F.lit("1"), F.lpad((i * 7919 % 1000000).cast("string"), 6, "0"))
    return e.select("event_id", checks.valid_rrn(d).alias("ok"))


@query
def cookie_parse(spark, sf):
    p = prep(spark, sf, "events").where(C("rq_cookie").isNotNull())
    rows = p.select("seq", F.posexplode(checks.cookie_pairs(C("rq_cookie"))).alias("pos", "c"))
    return rows.select("seq", C("pos").cast("bigint").alias("pos"), C("c.name").alias("name"), C("c.value").alias("value"))


@query
def jwt_decode(spark, sf):
    d = jwt.decoded(jwt.tokens(prep(spark, sf, "events")))
    return d.select("seq", F.sha2("token", 256).alias("token_sha"), "header", "payload")


@query
def jwt_claims(spark, sf):
    c = jwt.claims(jwt.decoded(jwt.tokens(prep(spark, sf, "events"))), F.lit(1750000000))
    return c.select("seq", "alg", "sub", "issued_at", "expires", "warnings")


@query
def token_info(spark, sf):
    d = jwt.decoded(jwt.tokens(prep(spark, sf, "events")))
    return d.select("seq", checks.token_subject(C("payload")).alias("subject"), checks.token_expiry(C("payload")).alias("expires"))


@query
def js_preview(spark, sf):
    return inv(spark, sf, "scripts").assets.select("sha256", "preview")


@query
def curl_text(spark, sf):
    e = ex(spark, sf, "events")
    return e.select("seq", sessions.curl_text(C("method"), C("url"), C("req_headers"), C("req_body")).alias("curl"))


REWRITE = [
    sessions.RewriteRule("REMOVE_HEADER", "Origin"),
    sessions.RewriteRule("HEADER", "User-Agent", match="probe", replacement="client"),
    sessions.RewriteRule("HEADER", "X-Trace", replacement="on", add_if_missing=True),
    sessions.RewriteRule("REMOVE_COOKIE", "_ga"),
    sessions.RewriteRule("HEADER", "content-type", match="^([a-z]+)/", regex=True, replacement="$1+"),
]


@query
def rewrite_requests(spark, sf):
    out = sessions.rewrite_requests(ex(spark, sf, "events"), REWRITE)
    return out.select("seq", nv(C("req_headers")).alias("headers"))


@query
def strip_auth(spark, sf):
    r = sessions.RewriteRule("STRIP_AUTH", keep_headers=("x-api-key",), keep_cookies=("csrftoken",))
    e = ex(spark, sf, "events")
    return e.select("seq", nv(sessions.strip_auth(C("req_headers"), r)).alias("headers"))


IDENTITIES = [sessions.Identity("bob", {"Authorization": "Bearer bob"}, {"sid": "B"})]


@query
def identity_rewrite(spark, sf):
    e = ex(spark, sf, "events").select("seq", "method", "host", "path", "req_headers")
    return sessions.identity_rewrite(e, IDENTITIES).select("seq", "identity", nv(C("req_headers")).alias("headers"))


@query
def rewrite_precheck(spark, sf):
    e = ex(spark, sf, "events")
    rules = [sessions.RewriteRule("HEADER", "Origin", match="web", replacement="x")]
    return sessions.rewrite_precheck(e, filters.in_scope(e, "", "track"), rules, IDENTITIES, 1750000000)


@query
def finding_value(spark, sf):
    f = inv(spark, sf, "events", "pages").findings
    return f.select("type", F.sha2(diff.finding_key(), 256).alias("fingerprint"),
                    classify.finding_value(C("type"), C("raw_match"), C("masked"), C("evidence"), C("sensitive")).alias("value"))


# --- detectors with their own shape -------------------------------------------------------


@query
def tech_fingerprint(spark, sf):
    return prep(spark, sf).select("seq", F.explode(detect.technologies()).alias("technology"))


@query
def auth_parts(spark, sf):
    r = sessions.auth_part_rows(ex(spark, sf, "events"))
    return r.select("seq", C("pos").cast("bigint").alias("pos"), "kind", "name", "confidence")


@query
def json_fields_query(spark, sf):
    p = prep(spark, sf, "events").where(C("is_json"))
    shallow = json_fields.shallow_names(C("body"))
    rows = p.select("seq", shallow.alias("sh"), F.explode(json_fields.json_fields(C("body"))).alias("f"))
    return rows.select("seq", C("f.name").alias("name"), C("f.value").alias("value"), F.array_contains("sh", C("f.name")).alias("shallow"))


QUERIES["json_fields"] = QUERIES.pop("json_fields_query")


@query
def jwt_weakness(spark, sf):
    return ev_out(jwt.weaknesses(jwt.tokens(prep(spark, sf, "events"))))


@query
def openapi_endpoints(spark, sf):
    o = specs.operations(specs.described(prep(spark, sf, "specs")))
    return o.select("seq", "kind", "method", "host", "path", "normalized_url")


@query
def openapi_params(spark, sf):
    return specs.openapi_params(specs.operations(specs.described(prep(spark, sf, "specs")))).select("seq", "endpoint_key", "location", "name")


@query
def graphql_fields(spark, sf):
    return specs.graphql_fields(specs.described(prep(spark, sf, "specs"))).select("seq", "method", "path", "normalized_url", joined(C("args")).alias("args"))


@query
def request_params(spark, sf):
    return rollup.parameter_events(prep(spark, sf)).select("seq", "endpoint_key", "location", "name", "value", "reflected")


@query
def json_params(spark, sf):
    return params.json_params(prep(spark, sf, "events")).select("seq", "endpoint_key", "name", "value", "reflected")


# --- JavaScript ----------------------------------------------------------------------------


@query
def js_kind(spark, sf):
    return inv(spark, sf, "scripts").kinds.select("sha256", "url", "kind")


@query
def js_links(spark, sf):
    return inv(spark, sf, "scripts").links.select("sha256", "js_url", "link")


@query
def js_routes(spark, sf):
    return ev_out(js.route_findings(inv(spark, sf, "scripts").links))


@query
def js_params(spark, sf):
    return inv(spark, sf, "scripts").hidden.select("sha256", "name", "interesting")


@query
def js_param_names(spark, sf):
    return js.js_param_names(inv(spark, sf, "scripts").hidden)


@query
def js_comments(spark, sf):
    k = inv(spark, sf, "scripts").kinds.where("deep")
    return ev_out(detect.explode_findings(k, detect.js_comments(C("body"), C("url"))))


@query
def js_lead_rules(spark, sf):
    k = inv(spark, sf, "scripts").kinds.where("deep")
    return ev_out(detect.explode_findings(k, detect.scan_rules("body", js_packs.LEAD_RULES, sensitive=False)))


@query
def js_notes(spark, sf):
    n = js.flat_notes(inv(spark, sf, "scripts").kinds)
    return n.select("sha256", F.split_part("note", F.lit("  |  Try: "), F.lit(1)).alias("note"))


@query
def js_note_rows(spark, sf):
    n = js.flat_notes(inv(spark, sf, "scripts").kinds)
    body = F.split_part("note", F.lit("  |  Try: "), F.lit(1))
    hint = F.regexp_extract("note", r"  \|  Try: (.*)$", 1)
    return n.select("sha256", F.regexp_extract(body, r"(?s)^(.*?): ", 1).alias("kind"), F.trim(F.regexp_replace(body, r"(?s)^.*?: ", "")).alias("detail"), (hint != "").alias("has_hint"))


@query
def sourcemap_refs(spark, sf):
    k = inv(spark, sf, "scripts").bodies
    return ev_out(detect.explode_findings(k, detect.sourcemap_refs(C("body"), C("url"))))


@query
def js_assets(spark, sf):
    a = inv(spark, sf, "scripts").assets
    return a.select("sha256", "url", "host", C("size").cast("bigint").alias("size"), "kind", "served", C("endpoint_count").cast("bigint").alias("endpoint_count"), C("secret_count").cast("bigint").alias("secret_count"))


@query
def js_body_store(spark, sf):
    i = inv(spark, sf, "scripts")
    return js.body_store(i.bodies, i.bodies.where(C("seq") % 3 == 0)).select("host", "file_name", "sha256")


@query
def js_noise(spark, sf):
    i = inv(spark, sf, "scripts")
    a = marts.with_risk(i.assets, marts.js_risk(i.js_findings))
    return filters.not_js_noise(a).select("sha256", "url", "kind", C("size").cast("bigint").alias("size"), "finding_count")


@query
def js_sourced_findings(spark, sf):
    i = inv(spark, sf, "scripts")
    return js.js_sourced(i.js_findings, i.assets).select("type", "severity", "location", "times_seen")


@query
def nonlibrary_findings(spark, sf):
    i = inv(spark, sf, "scripts")
    return js.nonlibrary(i.js_findings, i.assets).select("type", "severity", "location", "times_seen")


@query
def js_risk(spark, sf):
    return marts.js_risk(inv(spark, sf, "scripts").js_findings)


@query
def js_asset_risk(spark, sf):
    i = inv(spark, sf, "scripts")
    return marts.with_risk(i.assets, marts.js_risk(i.js_findings)).select("sha256", "url", "finding_count", "risk")


@query
def js_files_ranked(spark, sf):
    return marts.ranked(marts.js_risk(inv(spark, sf, "scripts").js_findings)).select("location", "score", "rank")


@query
def js_summary(spark, sf):
    return marts.js_summary(inv(spark, sf, "scripts").js_findings)


@query
def seen_flag(spark, sf):
    i, n = inv(spark, sf, "scripts"), inv(spark, sf, "events")
    p = rollup.parameters(rollup.parameter_events(n.prepared))
    s = marts.seen_flag(i.js_findings, n.endpoints, p)
    return s.select("type", F.sha2(diff.finding_key(), 256).alias("fingerprint"), "seen")


@query
def js_findings_view(spark, sf):
    i, n = inv(spark, sf, "scripts"), inv(spark, sf, "events")
    p = rollup.parameters(rollup.parameter_events(n.prepared))
    f = classify.with_category(marts.seen_flag(i.js_findings, n.endpoints, p))
    libs = i.assets.where(C("kind") != "").select(C("url").alias("location"), F.lit(True).alias("_lib")).distinct()
    f = f.join(shuffled(libs), "location", "left").withColumn("is_library", F.coalesce("_lib", F.lit(False))).withColumn("file", urls.js_file_label(C("location")))
    v = filters.js_findings_view(f, ["MEDIUM", "LOW"], "Auth", hide_library=True, untested_only=True)
    return v.select("type", "severity", "location", "file")


@query
def js_asset_detail(spark, sf):
    """Findings and links of every file, as rows of one table."""
    i = inv(spark, sf, "scripts")
    a = i.assets.select("sha256", "url")
    f = a.join(shuffled(i.js_findings.select(C("location").alias("url"), "type", "severity")), "url").select("sha256", F.lit("finding").alias("kind"), C("type").alias("item"))
    o = a.join(shuffled(js.link_origins(i.links).select(C("js_url").alias("url"), "normalized_url")), "url").select("sha256", F.lit("endpoint").alias("kind"), C("normalized_url").alias("item"))
    return f.unionByName(o)


# --- rollups and marts ----------------------------------------------------------------------


@query
def endpoints(spark, sf):
    return ep_out(inv(spark, sf).endpoints)


@query
def parameters(spark, sf):
    return inv(spark, sf).parameters.select("endpoint_key", "location", "name", "endpoint_path", "host", "example", "reflected", "seen")


@query
def findings(spark, sf):
    return fi_out(inv(spark, sf).findings)


EVERYTHING = ("events", "pages", "documents", "scripts", "specs")


@query
def merged_endpoints(spark, sf):
    """Endpoints of traffic, JavaScript and descriptions in one table."""
    return inv(spark, sf, *EVERYTHING).all_endpoints.select("method", "normalized_url", "observations", joined("sources").alias("sources"), "first_seq")


@query
def merged_parameters(spark, sf):
    """Parameters of traffic and of descriptions in one table."""
    return inv(spark, sf, *EVERYTHING).all_parameters.select("endpoint_key", "location", "name", "example", "seen", "first_seq")


@query
def merged_findings(spark, sf):
    """Findings of traffic, JavaScript (flat and structural) and descriptions, by type."""
    f = inv(spark, sf, *EVERYTHING).all_findings
    return f.groupBy("type").agg(F.count("*").alias("findings"), F.sum("times_seen").cast("bigint").alias("times_seen"), F.min("first_seq").alias("first_seq"))


@query
def finding_is_new(spark, sf):
    n = rollup.finding_is_new(inv(spark, sf).events)
    return n.groupBy("type", "is_new").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


@query
def tech(spark, sf):
    return rollup.tech(prep(spark, sf)).select("host", "technologies", joined(C("missing_headers")).alias("missing_headers"))


@query
def count_status(spark, sf):
    return rollup.counters(prep(spark, sf))[0].orderBy(F.desc("n"), "status").select(C("status").cast("bigint").alias("status"), "n")


@query
def count_host(spark, sf):
    return rollup.counters(prep(spark, sf))[1].orderBy(F.desc("n"), "host")


@query
def count_ctype(spark, sf):
    return rollup.counters(prep(spark, sf))[2].orderBy(F.desc("n"), "content_type")


@query
def top_hosts(spark, sf):
    return marts.top_bars(rollup.counters(prep(spark, sf))[1], "host")


@query
def top_status(spark, sf):
    return marts.top_bars(rollup.counters(prep(spark, sf))[0], "status").select(C("status").cast("bigint").alias("status"), "n", "percent")


@query
def top_ctypes(spark, sf):
    return marts.top_bars(rollup.counters(prep(spark, sf))[2], "content_type")


def _net(spark, sf):
    """Inventory of API and page traffic: what the marts are checked on."""
    return inv(spark, sf, "events", "pages")


@query
def host_scorecard(spark, sf):
    i = _net(spark, sf)
    return marts.host_scorecard(i.endpoints, i.parameters, i.findings, i.tech)


@query
def host_risk(spark, sf):
    i = _net(spark, sf)
    return marts.host_risk(i.endpoints, i.findings)


@query
def findings_by_severity(spark, sf):
    return marts.findings_by_severity(_net(spark, sf).findings)


@query
def findings_by_category(spark, sf):
    return marts.findings_by_category(_net(spark, sf).findings)


@query
def top_types(spark, sf):
    return marts.top_types(_net(spark, sf).findings)


@query
def notable_endpoints(spark, sf):
    i = inv(spark, sf)
    return marts.notable_endpoints(i.endpoints, i.endpoint_params)


@query
def class_summary(spark, sf):
    return marts.class_summary(inv(spark, sf).parameters)


@query
def report_summary(spark, sf):
    i = _net(spark, sf)
    return marts.report_summary(i.exchanges, endpoints=i.endpoints, parameters=i.parameters, findings=i.findings, hosts=i.tech)


@query
def host_schemes(spark, sf):
    return rollup.host_schemes(inv(spark, sf).endpoints)


@query
def guide_label(spark, sf):
    f = _net(spark, sf).findings.select("type").distinct().select(F.lit("type").alias("by"), C("type").alias("what"), classify.guide_for_type(C("type")).alias("guide"))
    ct = ex(spark, sf, "events").where(C("content_type").isNotNull()).select(F.lit("content").alias("by"), C("content_type").alias("what"), classify.guide_for_content(C("content_type")).alias("guide")).distinct()
    v = _values(spark, sf).select(F.explode(classify.name_classes(C("name"))).alias("cls")).distinct().select(F.lit("class").alias("by"), C("cls").alias("what"), classify.guide_for_class(C("cls")).alias("guide"))
    return f.unionByName(ct).unionByName(v)


@query
def per_body_cap(spark, sf):
    """The first 25 card matches of a body, as a reader asks for them, beside all of its comments."""
    p = prep(spark, sf)
    n = p.select("seq", F.size(F.slice(detect._pii_matches(packs.CARD), 1, 25)).cast("bigint").alias("card_matches"), F.size(detect.html_comments()).cast("bigint").alias("comments"))
    return n.where((C("card_matches") > 0) | (C("comments") > 0))


@query
def global_search(spark, sf):
    """Rows of the five tables, of API, page and document traffic and of scripts."""
    i, s = inv(spark, sf), inv(spark, sf, "scripts")
    idx = search.index(i.endpoints, i.parameters, i.findings, s.assets, i.tech_rows, i.tech)
    return search.SearchIndex.of(idx).search("api -graphql shop").groupBy("kind", "host").agg(F.count("*").alias("n"))


# --- sessions and replays --------------------------------------------------------------------


@query
def session_discovery(spark, sf):
    saved = [sessions.Identity("seven", {}, {"JSESSIONID": "S7"})]
    d = sessions.discover(ex(spark, sf, "events"), saved)
    return d.select("host", "requests", "last_seen", "sample_path", "credentials", "registered_as", "subject", "expires")


def _compared(spark, sf):
    return replay.compare(adapters.adapt(spark, sf, "replays"))


@query
def replay_compare(spark, sf):
    return _compared(spark, sf).select("ts", "verdict", "outcome", F.round("similarity", 6).alias("similarity"), C("length_delta").cast("bigint").alias("length_delta"))


@query
def body_similarity(spark, sf):
    d = adapters.read_table(spark, sf, "documents").select("doc_id", "text")
    pairs = d.join(d.select((C("doc_id") - 1).alias("doc_id"), C("text").alias("other")), "doc_id")
    return replay.similarity_columns(pairs, "text", "other").select("doc_id", F.round("similarity", 6).alias("similarity"))


@query
def replay_matrix(spark, sf):
    return replay.matrix(replay.cells(_compared(spark, sf)), ["Original", "No auth", "bob", "Custom"]).select(
        "target_key", C("Original").alias("original"), C("No auth").alias("no_auth"), "bob", C("Custom").alias("custom")
    )


@query
def matrix_counts(spark, sf):
    return replay.matrix_counts(replay.cells(_compared(spark, sf)))


@query
def matrix_filter(spark, sf):
    return replay.matrix_filter(replay.cells(_compared(spark, sf)), ["BLOCKED", "ERROR"]).select("target_key", "identity", "outcome")


@query
def matrix_suspicious(spark, sf):
    return replay.suspicious(replay.cells(_compared(spark, sf)))


# --- order, diff, delete ----------------------------------------------------------------------


@query
def ordered_endpoints(spark, sf):
    return inv(spark, sf).endpoints.select("host", "path", "method", "last_status").orderBy("host", "path")


@query
def ordered_parameters(spark, sf):
    return inv(spark, sf, "events").parameters.select("host", "endpoint_path", "location", "name", "seen").orderBy("host", "endpoint_path", "name")


@query
def ordered_findings(spark, sf):
    return rollup.severity_order(_net(spark, sf).findings).select("severity", "type", "masked", "times_seen")


@query
def ordered_tech(spark, sf):
    return inv(spark, sf).tech.select("host", F.size("missing_headers").cast("bigint").alias("missing")).orderBy("host")


@query
def ordered_js_assets(spark, sf):
    return inv(spark, sf, "scripts").kinds.select("url", C("size").cast("bigint").alias("size"), "kind").orderBy("url")


@query
def multi_sort(spark, sf):
    return inv(spark, sf).endpoints.select("host", "observations", "normalized_url").orderBy("host", F.desc("observations"), "normalized_url")


def _orders(spark, sf):
    o = adapters.read_table(spark, sf, "orders").select(
        (C("o_custkey")).alias("k"), C("o_orderkey").alias("seq"), "o_orderstatus", "o_orderpriority", C("o_orderdate").cast("string").alias("d")
    )
    return o.where(C("seq") % 3 != 0), o.where(C("seq") % 3 != 1)


def _okey():
    return F.when(C("k") % 50 != 0, C("k").cast("string"))


@query
def diff_added(spark, sf):
    old, new = _orders(spark, sf)
    return diff.added(old, new, _okey(), "seq").select("k", "seq", "o_orderstatus")


@query
def diff_removed(spark, sf):
    old, new = _orders(spark, sf)
    return diff.removed(old, new, _okey(), "seq").select("k", "seq", "o_orderstatus")


@query
def snapshot_diff(spark, sf):
    old, new = _orders(spark, sf)
    return diff.three_way(old, new, _okey(), F.concat_ws("|", "o_orderstatus", "o_orderpriority"), "seq")


def _snapshots(spark, sf):
    """Two captures that overlap by eight hours; what both hold is analysed once."""
    e = persist_table(ex(spark, sf, "events"), "exchanges")
    s = ex(spark, sf, "scripts")
    hour = F.hour("observed_at")
    early, shared, late = (Share(e.where(cond)) for cond in (hour < 8, hour.between(8, 15), hour >= 16))

    def tables(cond, *shares):
        i, j = together(*shares), Inventory(s.where(cond))
        return i | {"findings": rollup.findings(i["events"].unionByName(j.flat_js_events)), "js_assets": j.bodies}

    return tables(hour < 16, early, shared), tables(hour >= 8, shared, late)


@query
def snapshot_diff_all(spark, sf):
    d = diff.snapshot_diff(*_snapshots(spark, sf))
    return d.select("table", F.sha2("key", 256).alias("key_sha"), "change")


@query
def snapshot_diff_counts(spark, sf):
    return diff.diff_counts(diff.snapshot_diff(*_snapshots(spark, sf)))


@query
def delete_hosts(spark, sf):
    """Rows kept and deleted per table; the counters keep theirs."""
    i = inv(spark, sf)
    hosts = i.tech.where(C("host").rlike("^(?:api[0-2]|blog)")).select("host")
    status, _, _ = rollup.counters(i.prepared)
    scripts = inv(spark, sf, "scripts").assets.select(urls.host_of(C("url")).alias("host"))
    tables = {"endpoints": i.endpoints, "tech": i.tech, "technologies": i.tech_rows, "parameters": i.parameters, "findings": i.findings, "scripts": scripts}
    kept = diff.delete_hosts_all(tables, hosts) | {"requests": status}
    rows = [t.agg((F.sum("n") if n == "requests" else F.count("*")).cast("bigint").alias("n")).select(F.lit(f"kept {n}").alias("what"), "n") for n, t in kept.items()]
    gone = diff.deleted_counts(tables, hosts).select(F.concat(F.lit("deleted "), C("table")).alias("what"), C("deleted").alias("n"))
    return reduce(lambda a, b: a.unionByName(b), rows).unionByName(gone)


@query
def out_of_scope_hosts(spark, sf):
    i = inv(spark, sf)
    return diff.out_of_scope_hosts(rollup.counters(i.prepared)[1], i.tech, rollup.host_schemes(i.endpoints), r"^https://", r"docs")


@query
def line_diff(spark, sf):
    d = adapters.read_table(spark, sf, "documents").select("doc_id", "text")
    pairs = d.join(d.select((C("doc_id") - 1).alias("doc_id"), C("text").alias("other")), "doc_id")
    out = diff.line_diff(pairs, "text", "other", "doc_id")
    return out.groupBy("doc_id", "change").agg(F.count("*").alias("n"))


# --- sinks -------------------------------------------------------------------------------------


@query
def wordlist_paths(spark, sf):
    i = inv(spark, sf)
    return sinks.wordlist_paths(i.endpoints)


@query
def wordlist_params(spark, sf):
    i = inv(spark, sf)
    return sinks.wordlist_params(i.parameters, i.endpoint_params, js.js_param_names(inv(spark, sf, "scripts").hidden))


@query
def wordlist_hosts(spark, sf):
    i = inv(spark, sf)
    return sinks.wordlist_hosts(i.endpoints, i.tech)


@query
def csv_view(spark, sf):
    v = inv(spark, sf).endpoints.where(C("last_status") > 0).select("method", "host", "path", "last_status", "content_type").orderBy("host", "path")
    return sinks.csv_lines(v)


@query
def sarif_results(spark, sf):
    return sinks.sarif_results(_net(spark, sf).findings).select("rule_id", "level", "uri", "fingerprint")


@query
def sarif_rules(spark, sf):
    return sinks.sarif_rules(sinks.sarif_results(_net(spark, sf).findings))


@query
def report_json(spark, sf):
    i = _net(spark, sf)
    rows = sinks.json_rows({"findings": marts.report_rows(i.findings), "endpoints": i.endpoints, "parameters": i.parameters, "technologies": i.tech_report})
    return rows.groupBy("section").agg(F.count("*").alias("rows"))


@query
def merged_sarif(spark, sf):
    """SARIF results of traffic, scripts and descriptions, with the client flows, by rule and level."""
    i = inv(spark, sf, *EVERYTHING)
    r = sinks.sarif_results(i.all_findings, i.structural.flows)
    return r.groupBy("rule_id", "level").agg(F.count("*").alias("results"), F.count_distinct("fingerprint").alias("fingerprints"))


@query
def merged_report(spark, sf):
    """Rows of the report's six sections, from everything that is known."""
    i = inv(spark, sf, *EVERYTHING)
    flows = i.structural.flows.select("method", "path", "host", "type", "auth", "function", "sightings")
    rows = sinks.json_rows({
        "findings": marts.report_rows(i.all_findings), "endpoints": i.all_endpoints, "parameters": i.all_parameters,
        "technologies": i.tech_report, "js_files": marts.with_risk(i.assets, marts.js_risk(i.js_findings)), "client_flows": flows,
    })
    return rows.groupBy("section").agg(F.count("*").alias("rows"), F.sum((F.length("json") > 2).cast("bigint")).alias("filled"))


@query
def report_sections(spark, sf):
    """Endpoint section as the documents show it: short type, human sizes, triage labels."""
    i = _net(spark, sf)
    size = i.prepared.where(C("has_resp")).groupBy("nurl").agg(F.max(F.length("body")).alias("bytes"))
    e = i.endpoints.join(size, C("normalized_url") == C("nurl"), "left")
    return e.select("method", "normalized_url", text.short_content_type(C("content_type")).alias("type"), text.human_bytes(F.coalesce("bytes", F.lit(0))).alias("size"), text.triage_label(F.lit("NEW")).alias("triage"))


def _state(spark, sf):
    from sightline.session import scratch_path

    i = inv(spark, sf, "events")
    path = scratch_path(spark, "state")
    sinks.export_state({"endpoints": i.endpoints, "findings": i.findings.withColumn("triage", F.lit("odd")), "tech": i.tech}, path)
    return sinks.import_state(spark, path)


@query
def state_export(spark, sf):
    t = _state(spark, sf)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, df in sorted(t.items())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def state_import(spark, sf):
    return fi_out_state(_state(spark, sf)["findings"])


def fi_out_state(f):
    return f.groupBy("type", "severity", "triage").agg(F.count("*").alias("n"), F.sum("times_seen").alias("seen"))


# --- streams --------------------------------------------------------------------------------------


def _stream(spark, sf, table: str, stages) -> DataFrame:
    """The table as a stream, its rows dealt as those of a batch are: a split may hold most of them."""
    whole = adapters.read_table(spark, sf, table)
    src = spark.readStream.schema(whole.schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)
    parts = adapters.dealt(whole)
    src = src.repartition(parts) if parts else src
    for stage in stages(adapters.SparkDialect):
        src = src.selectExpr(*[f"{e} AS {a}" for a, e in stage])
    return src


def events_stream(spark, sf):
    return _stream(spark, sf, "events", adapters.events_stages)


@query
def stream_exchanges(spark, sf):
    from sightline.streaming import jobs

    return jobs.run_to_table(events_stream(spark, sf).select("seq", "method", "url", "status"), "stream-exchanges")


@query
def stream_endpoints(spark, sf):
    from sightline.streaming import jobs

    return ep_out(jobs.upsert_endpoints(events_stream(spark, sf)))


@query
def stream_retention(spark, sf):
    from sightline.streaming import jobs

    return jobs.upsert_endpoints(events_stream(spark, sf), cap=1000).select("method", "normalized_url", "first_seq")


@query
def stream_findings(spark, sf):
    from sightline.streaming import jobs

    f = jobs.finding_counts(events_stream(spark, sf))
    return f.select("type", "severity", "masked", F.sha2(F.concat(C("type"), F.lit("|"), C("raw_match")), 256).alias("fingerprint"), "times_seen", "first_seq")


@query
def stream_js_dedup(spark, sf):
    from sightline.streaming import jobs

    s = _stream(spark, sf, "events", adapters.scripts_stages)
    return jobs.new_js_bodies(s).select("sha256", C("size").cast("bigint").alias("size"))


@query
def stream_jwt(spark, sf):
    from sightline.streaming import jobs

    return jobs.token_issues(events_stream(spark, sf)).select("host", "issue")


@query
def stream_counters(spark, sf):
    from sightline.streaming import jobs

    return jobs.status_counters(events_stream(spark, sf)).select("host", C("status").cast("bigint").alias("status"), "n")


@query
def traffic_windows(spark, sf):
    from sightline.streaming import jobs

    return jobs.traffic_windows(ex(spark, sf, "events"))


@query
def traffic_sessions(spark, sf):
    from sightline.streaming import jobs

    client = F.regexp_extract(text.nz(headers.req("cookie")), r"JSESSIONID=([^;]*)", 1)
    e = headers.with_header_names(ex(spark, sf, "events"))
    return jobs.traffic_sessions(e, F.nullif(client, F.lit("")), "60 minutes")


# --- structural JavaScript ------------------------------------------------------------------------


def structural(spark, sf):
    return inv(spark, sf, "scripts").structural


@query
def js_tokens(spark, sf):
    return structural(spark, sf).tokens.select("sha256", "i", "off", "kind", "t", "depth", "match", "parent", "scope")


def _leads(pair):
    return pair[0].select("sha256", "type", "severity", "raw_match")


@query
def js_dom_flows(spark, sf):
    return _leads(structural(spark, sf).dom)


@query
def js_flow_notes(spark, sf):
    return structural(spark, sf).dom[1].select("sha256", "note")


@query
def js_guard_pairs(spark, sf):
    return _leads(structural(spark, sf).guard)


@query
def js_argument_pairs(spark, sf):
    return _leads(structural(spark, sf).argument)


@query
def client_flows(spark, sf):
    return structural(spark, sf).flows.select("method", "path", "host", "auth", "function", "via", "sightings")


@query
def client_flow_wrappers(spark, sf):
    return structural(spark, sf).calls.where(C("via").startswith("wrapper ")).select("sha256", "method", "path", "via", "function")


@query
def client_flow_triggers(spark, sf):
    return structural(spark, sf).calls.select("sha256", "method", "path", "function", "trigger")


@query
def flow_type(spark, sf):
    return structural(spark, sf).flows.select("method", "path", "type", "id_parameter")


@query
def flow_template(spark, sf):
    from sightline.operators import flows

    s = structural(spark, sf)
    return flows.request_template(s.flows, flows.keys(s.calls))


def _flow_seen(spark, sf):
    from sightline.operators import flows

    return flows.flow_seen(structural(spark, sf).flows, inv(spark, sf, "events").endpoints)


@query
def flow_seen(spark, sf):
    return _flow_seen(spark, sf).select("method", "path", "seen")


@query
def untested_flows(spark, sf):
    from sightline.operators import flows

    return flows.untested(_flow_seen(spark, sf)).select("method", "path", "type")


@query
def flow_summary(spark, sf):
    from sightline.operators import flows

    return flows.summary(_flow_seen(spark, sf))
