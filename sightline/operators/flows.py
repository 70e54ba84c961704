"""Client flows: calls found in JavaScript, keyed by method and path template."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import classify, urls
from sightline.functions.text import first_match, nz, rl
from sightline.session import persist_table, shuffled

TYPE = "Client Flow"
TYPE_IDOR = "Client Flow: IDOR candidate"
TYPE_NO_AUTH = "Client Flow: no auth in call"
ID_SUFFIX = r"(?:[a-z0-9](?:Id|ID|No|Seq|Idx)|_(?:id|no|seq|idx))$"


def template_host(path: Column) -> Column:
    clean = F.regexp_replace(path, r"\{[^}]{0,60}\}", "x")
    return F.when(path.rlike(r"^https?://"), F.try_parse_url(clean, F.lit("HOST")))


def rollup(calls: DataFrame) -> DataFrame:
    """Flows from call sightings (seq, ord, js_url, method, path, auth, function, trigger, via,
    call_site): the first non-empty value of each attribute wins."""
    order = F.struct("seq", "ord")

    def first(c: str) -> Column:
        return F.min(F.when(nz(F.col(c)) != "", F.struct(order.alias("o"), F.col(c).alias("v")))).alias(f"_{c}")

    g = calls.groupBy("method", "path").agg(
        *[first(c) for c in ("auth", "function", "trigger", "via", "call_site", "js_url")], F.count("*").alias("sightings"), F.min("seq").alias("first_seq"),
    )
    own = template_host(F.col("path"))
    out = g.select(
        "method", "path", *[nz(F.col(f"_{c}.v")).alias(c) for c in ("auth", "function", "trigger", "via", "call_site", "js_url")], "sightings", "first_seq",
    )
    return out.withColumn("host", F.coalesce(own, urls.host_of(F.col("js_url")))).withColumn(
        "secure", ~F.col("js_url").startswith("http://")
    )


def keys(calls: DataFrame) -> DataFrame:
    """Distinct body and query keys of each flow with their first-seen place."""
    b = calls.select("method", "path", "seq", "ord", F.lit("body").alias("kind"), F.posexplode("body_keys").alias("pos", "key"))
    q = calls.select("method", "path", "seq", "ord", F.lit("query").alias("kind"), F.posexplode("query_keys").alias("pos", "key"))
    return b.unionByName(q).groupBy("method", "path", "kind", "key").agg(F.min(F.struct("seq", "ord", "pos")).alias("first"))


def js_urls(calls: DataFrame) -> DataFrame:
    return calls.select("method", "path", "js_url").distinct()


def path_only(path: Column) -> Column:
    p = F.regexp_replace(nz(path), r"(?s)\A.*?://[^/]*", "")
    return F.regexp_replace(p, r"\A(?!/)", "/")


def is_id_name(name: Column) -> Column:
    return (nz(name) != "") & (classify.in_class(name, "IDOR") | rl(name, ID_SUFFIX))


def with_type(flows: DataFrame, flow_keys: DataFrame) -> DataFrame:
    """Adds id_parameter and type."""
    order = F.when(F.col("kind") == "query", 0).otherwise(1)
    ids = flow_keys.where(is_id_name(F.col("key"))).groupBy("method", "path").agg(
        F.min(F.struct(order.alias("k"), "first", "key")).alias("i")
    ).select("method", "path", F.col("i.key").alias("_key_id"))
    holders = F.regexp_extract_all("path", F.lit(r"\{([^}/]{1,60})\}"), F.lit(1))
    place = F.get(F.filter(holders, is_id_name), F.lit(0))
    numeric = rl(path_only(F.col("path")), r"/\d{1,19}(?=/|$)")
    f = flows.join(shuffled(ids), ["method", "path"], "left").withColumn("_place", place)
    picked = (
        F.when(F.col("_place").isNotNull(), F.concat(F.lit("{"), F.col("_place"), F.lit("}")))
        .when(numeric, F.lit("the numeric path segment")).otherwise(F.col("_key_id"))
    )
    f = f.withColumn("id_parameter", picked).drop("_place", "_key_id")
    t = first_match([(F.col("id_parameter").isNotNull(), TYPE_IDOR), (nz(F.col("auth")) == "", TYPE_NO_AUTH)], TYPE)
    return f.withColumn("type", t)


def hint(flow_type: Column, id_parameter: Column) -> Column:
    base = classify.hint_for_type(flow_type)
    return F.when(
        (flow_type == TYPE_IDOR) & id_parameter.isNotNull(), F.concat(F.lit("change "), id_parameter, F.lit(" to another user's value -- "), base)
    ).otherwise(base)


def request_template(flows: DataFrame, flow_keys: DataFrame) -> DataFrame:
    """Text of a request for each flow, with empty values.

    Key lists are put together per flow; a flow's keys come from the call sites of one
    method and path, and are deduplicated first.
    """
    listed = flow_keys.groupBy("method", "path").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "query", F.struct("first", "key")))).alias("q"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "body", F.struct("first", "key")))).alias("b"),
    )
    none = F.array().cast("array<string>")
    f = flows.join(shuffled(listed), ["method", "path"], "left").select(
        "*", F.coalesce(F.transform("q", lambda x: x["key"]), none).alias("qk"), F.coalesce(F.transform("b", lambda x: x["key"]), none).alias("bk")
    )
    absolute = F.col("path").rlike(r"^https?://")
    authority = F.regexp_extract("path", r"^https?://([^/]*)", 1)
    secure = F.when(absolute, F.col("path").startswith("https://")).otherwise(F.col("secure"))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    host = F.when(absolute, F.regexp_replace(authority, r":\d+$", "")).otherwise(F.col("host"))
    query = F.when(F.size("qk") > 0, F.concat(F.lit("?"), F.array_join(F.transform("qk", lambda k: F.concat(k, F.lit("="))), "&"))).otherwise(F.lit(""))
    header = F.split_part(nz(F.col("auth")), F.lit(" "), F.lit(1))
    auth = F.when((header != "") & ~header.startswith("cookies"), F.concat(header, F.lit(": <token>\r\n"))).otherwise(F.lit(""))
    json = F.concat(F.lit("{"), F.array_join(F.transform("bk", lambda k: F.concat(F.lit('"'), F.replace(k, F.lit('"'), F.lit("")), F.lit('":""'))), ","), F.lit("}"))
    has_body = (F.size("bk") > 0) | F.col("method").isin("POST", "PUT", "PATCH")
    body_head = F.concat(F.lit("Content-Type: application/json\r\nContent-Length: "), F.octet_length(json).cast("string"), F.lit("\r\n"))
    raw = F.concat(
        F.col("method"), F.lit(" "), path_only(F.col("path")), query, F.lit(" HTTP/1.1\r\nHost: "), host,
        F.lit("\r\nAccept: application/json, text/plain, */*\r\n"), auth, F.when(has_body, body_head).otherwise(F.lit("")), F.lit("\r\n"),
        F.when(has_body, json).otherwise(F.lit("")),
    )
    return f.select(
        "method", "path", host.alias("host"), F.coalesce(F.nullif(port, F.lit("")).cast("int"), F.when(secure, 443).otherwise(80)).alias("port"),
        secure.alias("secure"), raw.alias("raw"),
    )


def _segments(p: Column) -> Column:
    return F.split(F.regexp_replace(p, r"(?<=.)/+\z", ""), "/")


_HOLDER = r"\{[^}]*\}"
#: A whole placeholder segment in the trie; no segment of a template can look like it.
_ANY = "{}"


def trie(flows: DataFrame) -> DataFrame:
    """Edges of the templates' segments: verb, parent, edge, node, prefix (of a partly literal segment, else null), last.

    Templates that begin alike share their nodes; a node is named by the edges down to it.
    Placeholders are all written alike, so a node has one edge at most that takes any segment.
    """
    c = F.col
    seg = F.transform(_segments(path_only(c("path"))), lambda s: F.regexp_replace(s, _HOLDER, _ANY))
    t = flows.select(F.upper("method").alias("verb"), seg.alias("seg")).distinct()
    upto = lambda k: F.array_join(F.slice("seg", F.lit(1), k), "/")
    steps = F.transform(F.sequence(F.lit(1), F.size("seg")), lambda k: F.struct(
        F.when(k == 1, F.lit("")).otherwise(F.concat(F.lit("/"), upto(k - 1))).alias("parent"), F.get("seg", k - 1).alias("edge"), F.concat(F.lit("/"), upto(k)).alias("node"), (k == F.size("seg")).alias("last"),
    ))
    e = t.select("verb", F.explode(steps).alias("e")).select("verb", "e.*")
    mixed = c("edge").contains(_ANY) & (c("edge") != _ANY)
    return e.groupBy("verb", "parent", "edge", "node").agg(F.bool_or("last").alias("last")).withColumn("prefix", F.when(mixed, F.substring_index("edge", _ANY, 1)))


def flow_seen(flows: DataFrame, eps: DataFrame) -> DataFrame:
    """Adds ``seen``: an answered endpoint of the same method matches the path template, a placeholder standing for (part of) one segment.

    The routes of the endpoints go down the trie of the templates, a level a round: along the literal
    edge that equals their next segment, the edge that takes any segment, and the partly literal edges
    that begin like it. A route is only ever joined with edges of the node it has reached, by a key that
    holds the node and what the segment has in common with the edge.
    """
    c = F.col
    edges = persist_table(trie(flows), "flow-trie")
    literal = edges.where(c("prefix").isNull() & (c("edge") != _ANY)).select("verb", c("parent").alias("at"), c("edge").alias("s"), "node", "last")
    any_ = edges.where(c("edge") == _ANY).select("verb", c("parent").alias("at"), "node", "last")
    part = edges.where(c("prefix").isNotNull()).withColumn("size", F.length("prefix"))
    quoted = F.regexp_replace("edge", r"([\\^$.|?*+()\[\]])", r"\\$1")
    part = part.select("verb", c("parent").alias("at"), "size", "prefix", F.concat(F.lit("\\A"), F.replace(quoted, F.lit(_ANY), F.lit("[^/]+")), F.lit("\\z")).alias("pattern"), "node", "last")
    sizes = part.select("verb", "at", "size").distinct()
    routes = eps.where(c("last_status") != 0).select(F.upper("method").alias("verb"), _segments(urls.route_path(c("path"))).alias("left")).distinct()
    live = persist_table(routes.select("verb", "left", F.lit("").alias("at")), "flow-routes")
    hits = []
    while not live.isEmpty():  # a round a level; a route leaves when no edge takes its segment
        step = live.select("verb", "at", F.get("left", F.lit(0)).alias("s"), F.slice("left", F.lit(2), F.size("left")).alias("left"))
        along = step.join(shuffled(literal), ["verb", "at", "s"]).select("verb", "left", "node", "last")
        along = along.unionByName(step.where(c("s") != "").join(shuffled(any_), ["verb", "at"]).select("verb", "left", "node", "last"))
        begun = step.join(shuffled(sizes), ["verb", "at"]).withColumn("prefix", F.substr("s", F.lit(1), c("size")))
        along = along.unionByName(begun.join(shuffled(part), ["verb", "at", "size", "prefix"]).where(F.rlike("s", c("pattern"))).select("verb", "left", "node", "last"))
        along = persist_table(along, "flow-routes")
        hits.append(along.where(c("last") & (F.size("left") == 0)).select("verb", "node"))
        live = along.where(F.size("left") > 0).select("verb", "left", c("node").alias("at")).distinct()
    f = flows.withColumn("verb", F.upper("method")).withColumn("node", F.concat(F.lit("/"), F.array_join(F.transform(_segments(path_only(c("path"))), lambda s: F.regexp_replace(s, _HOLDER, _ANY)), "/")))
    if not hits:
        return f.withColumn("seen", F.lit(False)).drop("verb", "node")
    found = reduce(lambda a, b: a.unionByName(b), hits).distinct().withColumn("_s", F.lit(True))
    return f.join(shuffled(found), ["verb", "node"], "left").withColumn("seen", F.coalesce("_s", F.lit(False))).drop("_s", "verb", "node").select(*flows.columns, "seen")


def untested(flows_seen: DataFrame) -> DataFrame:
    return flows_seen.where(~F.col("seen"))


def summary(flows_typed_seen: DataFrame) -> DataFrame:
    return flows_typed_seen.agg(
        F.count("*").alias("flows"), F.count_if(~F.col("seen")).alias("untested"), F.count_if(F.col("type") == TYPE_IDOR).alias("idor"),
    )
