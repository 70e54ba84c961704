"""JSON parameters of request bodies: ``a.b``, ``a[]``, at every level; an array stands for its first element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import nz
from sightline.operators import filters

_NODES = "array<struct<name:string,v:variant>>"


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def _primitive(v: Column) -> Column:
    return ~(_is(v, "OBJECT") | _is(v, "ARRAY") | (F.schema_of_variant(v) == "VOID"))


def _enter_arrays(node: Column) -> Column:
    """The node itself, or the first element of an array (of arrays), named ``name[]``."""
    first = lambda n, _: F.struct(F.concat(n["name"], F.lit("[]")).alias("name"), F.try_variant_get(n["v"], "$[0]", "variant").alias("v"))
    nested = F.length(F.regexp_extract(F.to_json(node["v"]), r"^\[*", 0))
    return F.when(_is(node["v"], "ARRAY"), F.aggregate(F.sequence(F.lit(1), nested), node, first)).otherwise(node)


def _members(node: Column) -> Column:
    return F.transform(
        F.map_entries(F.try_variant_get(node["v"], "$", "map<string,variant>")),
        lambda e: F.struct(
            F.when(node["name"] == "", e["key"]).otherwise(F.concat(node["name"], F.lit("."), e["key"])).alias("name"),
            e["value"].alias("v"),
        ),
    )


def _all_members(root: Column, text: Column) -> Column:
    """The members of every object, level by level. No body has more levels than opening braces."""
    empty = F.array().cast(_NODES)

    def level(a: Column, _: Column) -> Column:
        inside = F.filter(F.transform(a["level"], _enter_arrays), lambda n: _is(n["v"], "OBJECT"))
        below = F.coalesce(F.flatten(F.transform(inside, _members)), empty).cast(_NODES)
        deeper = F.transform(F.array(below), lambda b: F.struct(b.alias("level"), F.concat(a["out"], b).alias("out")))[0]
        return F.when(F.size(a["level"]) == 0, a).otherwise(deeper)

    braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    top = F.array(F.struct(F.lit("").alias("name"), root.alias("v"))).cast(_NODES)
    return F.when(braces > 0, F.aggregate(F.sequence(F.lit(1), braces), F.struct(top.alias("level"), empty.alias("out")), level, lambda a: a["out"])).otherwise(empty)


def json_params(prepared: DataFrame) -> DataFrame:
    """seq, pos, endpoint_key, endpoint_path, location JSON, name, value, reflected."""
    df = prepared.where(filters.is_json(F.col("rq_ct")) & (F.trim(nz(F.col("req_body"))) != ""))
    df = df.select("seq", "nurl", "ep_path", "body", "has_resp", "req_body", F.try_parse_json("req_body").alias("root")).where(
        F.col("root").isNotNull()
    )
    rows = df.select("seq", "nurl", "ep_path", "body", "has_resp", F.posexplode(_all_members(F.col("root"), F.col("req_body"))).alias("pos", "n"))
    value = F.when(_primitive(F.col("n.v")), F.try_variant_get("n.v", "$", "string")).otherwise(F.lit(""))
    body = F.when(F.col("has_resp"), F.col("body")).otherwise(F.lit(""))
    out = rows.select(
        "seq", (F.col("pos") + 10_000).alias("pos"), F.col("nurl").alias("endpoint_key"), F.col("ep_path").alias("endpoint_path"),
        F.lit("JSON").alias("location"), F.col("n.name").alias("name"), value.alias("value"), body.alias("b"),
    )
    return out.withColumn("reflected", (F.length("value") >= 4) & F.col("b").contains(F.col("value"))).drop("b")
