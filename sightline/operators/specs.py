"""API surface from captured descriptions: OpenAPI / Swagger and GraphQL introspection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import urls
from sightline.functions.text import nz
from sightline.operators.detect import finding
from sightline.rules import packs


def described(prepared: DataFrame) -> DataFrame:
    """The exchanges that describe an interface, marked by how; what reads descriptions goes over these alone."""
    body = F.col("body")
    lead = F.left(F.regexp_replace(body, r"\A\s+", ""), F.lit(32))
    jsonish = F.col("is_json") | lead.startswith("{")
    ct = F.lower(F.col("ct"))
    yamlish = ~jsonish & (ct.contains("yaml") | lead.rlike(r"(?i)^(?:openapi|swagger)\s{0,8}:"))
    ok = F.col("has_resp")
    marked = prepared.select(
        "seq", "url", "body",
        (ok & jsonish & body.contains('"paths"') & (body.contains('"openapi"') | body.contains('"swagger"'))).alias("spec_json"),
        (ok & yamlish & body.contains("paths:") & (body.contains("openapi:") | body.contains("swagger:"))).alias("spec_yaml"),
        (ok & jsonish & body.contains('"__schema"') & body.contains('"types"')).alias("gql"),
    )
    return marked.where(F.col("spec_json") | F.col("spec_yaml") | F.col("gql"))


@F.pandas_udf(T.StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """YAML description to JSON; NULL where it is not YAML.  Only spec-like rows get here.
    A missing parser is an error of the job: descriptions would vanish without a word."""
    import json

    import yaml

    def one(t):
        try:
            return json.dumps(yaml.safe_load(t), default=str)
        except (yaml.YAMLError, ValueError, TypeError, RecursionError):
            return None

    return texts.map(one)


def _variants(found: DataFrame) -> DataFrame:
    js = found.where("spec_json").select("seq", "url", F.try_parse_json("body").alias("v"))
    ym = found.where("spec_yaml").select("seq", "url", F.try_parse_json(yaml_to_json("body")).alias("v"))
    return js.unionByName(ym).where(F.col("v").isNotNull())


def _text(v: Column, path: str) -> Column:
    return nz(F.try_variant_get(v, path, "string"))


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def operations(found: DataFrame) -> DataFrame:
    """One row per operation of the ``described``: seq, url, method, host, path, normalized_url, kind, params."""
    v = F.col("v")
    has_openapi = F.try_variant_get(v, "$.openapi", "variant").isNotNull()
    kind = F.trim(F.when(has_openapi, F.concat(F.lit("OpenAPI "), _text(v, "$.openapi"))).otherwise(F.concat(F.lit("Swagger "), _text(v, "$.swagger"))))
    paths = _variants(found).select(
        "seq", "url", kind.alias("kind"), F.trim(_text(v, "$.basePath")).alias("base_path"),
        F.posexplode(F.map_entries(F.try_variant_get(v, "$.paths", "map<string,variant>"))).alias("ppos", "p"),
    )
    base = F.when(F.col("base_path") == "/", F.lit("")).otherwise(F.col("base_path"))
    p = F.trim(F.col("p.key"))
    slashed = F.when(~p.startswith("/") & ~base.endswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
    full = F.concat(base, slashed)
    items = paths.select(
        "seq", "url", "kind", "ppos", F.when(full == "", F.lit("/")).otherwise(full).alias("path"),
        F.col("p.value").alias("item"), _items(F.col("p.value"), "$.parameters").alias("shared"),
    ).select("*", F.posexplode(F.map_entries(_map(F.col("item")))).alias("mpos", "m"))
    ops = items.where(
        F.lower("m.key").isin(packs.HTTP_METHODS) & _map(F.col("m.value")).isNotNull()
    )
    params = F.concat(F.col("shared"), _items(F.col("m.value"), "$.parameters"))
    named = F.filter(
        F.transform(params, lambda q: F.struct(_text(q, "$.name").alias("name"), F.lower(_text(q, "$.in")).alias("in_"))),
        lambda q: q["name"] != "",
    )
    return ops.select(
        "seq", "url", "kind", F.upper("m.key").alias("method"), urls.host_of(F.col("url")).alias("host"), "path",
        F.concat(urls.base_authority(F.col("url")), F.col("path")).alias("normalized_url"), named.alias("params"),
    )


_LOCATIONS = {"query": "QUERY", "header": "HEADER", "cookie": "COOKIE", "body": "BODY", "formdata": "BODY"}


def openapi_params(ops: DataFrame) -> DataFrame:
    """Declared parameters by location; path parameters have no location and are left out."""
    rows = ops.select("seq", "normalized_url", "path", F.posexplode("params").alias("pos", "q"))
    loc = F.create_map(*[F.lit(x) for kv in _LOCATIONS.items() for x in kv])[F.col("q.in_")]
    return rows.select(
        "seq", "pos", F.col("normalized_url").alias("endpoint_key"), F.col("path").alias("endpoint_path"),
        loc.alias("location"), F.col("q.name").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("reflected"),
    ).where(F.col("location").isNotNull())


def _as_endpoint_events(df: DataFrame, source: str) -> DataFrame:
    return df.select(
        "seq", F.lit(None).cast("timestamp").alias("observed_at"), "method", "host", "path", "normalized_url",
        F.lit(0).alias("status"), F.lit("").alias("content_type"), F.lit(source).alias("source"),
        F.lit(None).cast("boolean").alias("authed"),
    )


def openapi_endpoint_events(ops: DataFrame) -> DataFrame:
    return _as_endpoint_events(ops, "spec")


def spec_findings(ops: DataFrame) -> DataFrame:
    per = ops.groupBy("seq", "url").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    f = finding(
        "API spec exposed", "INFO", F.concat(F.lit("spec|"), F.col("url")), F.col("url"),
        F.concat(F.col("kind"), F.lit(", "), F.col("n").cast("string"), F.lit(" ops")),
    )
    return per.select("seq", F.lit(2_000_000).alias("ord"), f.alias("f")).select("seq", "ord", "f.*")


def graphql_fields(found: DataFrame) -> DataFrame:
    """One row per callable field of the ``described``: seq, url, host, path, normalized_url, args."""
    k = found.where("gql").select("seq", "url", F.try_parse_json("body").alias("v")).where(F.col("v").isNotNull())
    types = F.coalesce(
        F.try_variant_get("v", "$.data.__schema.types", "array<variant>"),
        F.try_variant_get("v", "$.__schema.types", "array<variant>"),
    )
    t = k.select("seq", "url", F.explode(types).alias("t"))
    t = t.select("seq", "url", _text(F.col("t"), "$.kind").alias("kind"), _text(F.col("t"), "$.name").alias("type_name"), "t")
    t = t.where(F.col("kind").isin("OBJECT", "INTERFACE") & (F.col("type_name") != "") & ~F.col("type_name").startswith("__"))
    f = t.select("seq", "url", "type_name", F.explode(_items(F.col("t"), "$.fields")).alias("f"))
    f = f.select("seq", "url", "type_name", _text(F.col("f"), "$.name").alias("field"), "f").where(F.col("field") != "")
    args = F.array_distinct(F.filter(F.transform(_items(F.col("f"), "$.args"), lambda a: _text(a, "$.name")), lambda n: n != ""))
    path = F.concat(F.lit("/graphql#"), F.col("type_name"), F.lit("."), F.col("field"))
    return f.select(
        "seq", "url", F.lit("POST").alias("method"), urls.host_of(F.col("url")).alias("host"), path.alias("path"),
        F.concat(urls.base_authority(F.col("url")), path).alias("normalized_url"), args.alias("args"),
    )


def graphql_endpoint_events(fields: DataFrame) -> DataFrame:
    return _as_endpoint_events(fields, "graphql")


def graphql_params(fields: DataFrame) -> DataFrame:
    return fields.select(
        "seq", F.posexplode("args").alias("pos", "name"), F.col("normalized_url").alias("endpoint_key"), F.col("path").alias("endpoint_path"),
        F.lit("JSON").alias("location"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("reflected"),
    )


def graphql_findings(fields: DataFrame) -> DataFrame:
    per = fields.groupBy("seq", "url").agg(F.count("*").alias("n"))
    key = F.when(urls.host_of(F.col("url")) == "", F.col("url")).otherwise(urls.host_of(F.col("url")))
    f = finding(
        "GraphQL schema parsed", "INFO", F.concat(F.lit("gql-schema|"), key), F.col("url"),
        F.concat(F.col("n").cast("string"), F.lit(" fields discovered")),
    )
    return per.select("seq", F.lit(2_000_001).alias("ord"), f.alias("f")).select("seq", "ord", "f.*")
