"""Keyed differences of two snapshots, host deletion, line differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import nz
from sightline.operators import filters


def by_key(df: DataFrame, key: Column, order: str | None = None) -> DataFrame:
    """One row per non-null key: the last one by ``order``."""
    rows = df.withColumn("_key", key).where(F.col("_key").isNotNull())
    if order is None:
        return rows.dropDuplicates(["_key"])
    cols = [c for c in df.columns]
    return rows.groupBy("_key").agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("_r")).select(
        "_key", *[F.col(f"_r.{c}").alias(c) for c in cols]
    )


def added(old: DataFrame, new: DataFrame, key: Column, order: str | None = None) -> DataFrame:
    return by_key(new, key, order).join(old.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def removed(old: DataFrame, new: DataFrame, key: Column, order: str | None = None) -> DataFrame:
    return added(new, old, key, order)


def three_way(old: DataFrame, new: DataFrame, key: Column, signature: Column, order: str | None = None) -> DataFrame:
    """key and change: ``+`` new, ``-`` gone, ``~`` signature differs."""
    o = by_key(old, key, order).select("_key", nz(signature).alias("_os"), F.lit(True).alias("_o"))
    n = by_key(new, key, order).select("_key", nz(signature).alias("_ns"), F.lit(True).alias("_n"))
    j = o.join(n, "_key", "full_outer")
    change = (
        F.when(F.col("_o").isNull(), "+").when(F.col("_n").isNull(), "-").when(F.col("_os") != F.col("_ns"), "~")
    )
    return j.select(F.col("_key").alias("key"), change.alias("change")).where(F.col("change").isNotNull())


def keyed_sets_differ(old: DataFrame, new: DataFrame, key: str, member: str) -> DataFrame:
    """Keys whose child rows differ: an exact comparison of sets that never collects one."""
    o = old.select(key, member).distinct().withColumn("_o", F.lit(1))
    n = new.select(key, member).distinct().withColumn("_n", F.lit(1))
    return o.join(n, [key, member], "full_outer").where(F.col("_o").isNull() | F.col("_n").isNull()).select(key).distinct()


def endpoint_key() -> Column:
    return F.concat(F.col("method"), F.lit(" "), F.col("normalized_url"))


def parameter_key() -> Column:
    return F.concat(F.col("endpoint_key"), F.lit("|"), F.col("location"), F.lit(":"), F.col("name"))


def finding_key() -> Column:
    return F.concat(F.col("type"), F.lit("|"), F.col("raw_match"))


def _with_children(base: DataFrame, moved: DataFrame, old: DataFrame, new: DataFrame, key: Column) -> DataFrame:
    """Adds ``~`` for keys on both sides of which only the child rows differ."""
    both = old.select(key.alias("key")).distinct().join(new.select(key.alias("key")).distinct(), "key")
    extra = moved.join(both, "key", "left_semi").join(base.select("key"), "key", "left_anti").select("key", F.lit("~").alias("change"))
    return base.unionByName(extra)


def snapshot_diff(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Changes of the five tables: table, key, change.

    Keys: endpoints, parameters, findings, js_assets, tech; the child tables
    endpoint_params and tech_rows take part in their parents' signatures.
    """
    out = []
    sig_ep = F.concat_ws("|", F.col("last_status").cast("string"), F.col("content_type"))
    ep = three_way(old["endpoints"], new["endpoints"], endpoint_key(), sig_ep)
    pk = lambda df: df.select(endpoint_key().alias("key"), "name")
    moved = keyed_sets_differ(pk(old["endpoint_params"]), pk(new["endpoint_params"]), "key", "name")
    out.append(("endpoints", _with_children(ep, moved, old["endpoints"], new["endpoints"], endpoint_key())))
    sig_p = F.concat_ws("|", F.col("reflected").cast("string"), F.col("example"))
    out.append(("parameters", three_way(old["parameters"], new["parameters"], parameter_key(), sig_p)))
    sig_f = F.concat_ws("|", "severity", "masked")
    out.append(("findings", three_way(old["findings"], new["findings"], finding_key(), sig_f)))
    out.append(("js_assets", three_way(old["js_assets"], new["js_assets"], F.col("sha256"), F.col("sha256"))))
    tech = three_way(old["tech"], new["tech"], F.col("host"), F.array_join("missing_headers", "|"))
    tk = lambda df: df.select(F.col("host").alias("key"), "technology")
    moved = keyed_sets_differ(tk(old["tech_rows"]), tk(new["tech_rows"]), "key", "technology")
    out.append(("tech", _with_children(tech, moved, old["tech"], new["tech"], F.col("host"))))
    parts = [df.select(F.lit(name).alias("table"), "key", "change") for name, df in out]
    return reduce(lambda a, b: a.unionByName(b), parts)


def diff_counts(diff: DataFrame) -> DataFrame:
    """added / removed / changed per table and the ``+a/-r/~c`` text."""
    g = diff.groupBy("table").pivot("change", ["+", "-", "~"]).count()
    c = g.select("table", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(n) for x, n in (("+", "added"), ("-", "removed"), ("~", "changed"))])
    text = F.concat(F.lit("+"), F.col("added").cast("string"), F.lit("/-"), F.col("removed").cast("string"), F.lit("/~"), F.col("changed").cast("string"))
    return c.withColumn("summary", text)


def delete_hosts(df: DataFrame, hosts: DataFrame, host_column: str = "host") -> DataFrame:
    """Rows of other hosts."""
    return df.join(hosts.select(F.col("host").alias(host_column)).distinct(), host_column, "left_anti")


def delete_hosts_all(tables: dict[str, DataFrame], hosts: DataFrame) -> dict[str, DataFrame]:
    """Every table without the hosts' rows; tables without a host column stay as they are."""
    return {name: delete_hosts(df, hosts) if "host" in df.columns else df for name, df in tables.items()}


def deleted_counts(tables: dict[str, DataFrame], hosts: DataFrame) -> DataFrame:
    parts = [
        df.join(hosts.select("host").distinct(), "host", "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(t).alias("table"), "deleted")
        for t, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def out_of_scope_hosts(counted: DataFrame, tech: DataFrame, schemes: DataFrame, include: str, exclude: str) -> DataFrame:
    """Known hosts whose root URL, under the scheme seen for them, is out of scope."""
    hosts = counted.select("host").unionByName(tech.select("host")).where(nz(F.col("host")) != "").distinct()
    s = schemes.select(F.col("host").alias("_h"), "scheme")
    j = hosts.join(s, F.lower(hosts["host"]) == F.col("_h"), "left")
    j = j.withColumn("url", F.concat(F.coalesce("scheme", F.lit("https")), F.lit("://"), F.col("host"), F.lit("/")))
    return j.where(~filters.in_scope(j, include, exclude)).select("host", "url")


def line_diff(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Positional line difference of two whole texts per key: key, pos, old, new, change."""
    def lines(col: str, out: str) -> DataFrame:
        return df.select(key, F.posexplode(F.split(nz(F.col(col)), r"\r?\n")).alias("pos", out))

    j = lines(a, "old").join(lines(b, "new"), [key, "pos"], "full_outer")
    change = F.when(F.col("old").isNull(), "+").when(F.col("new").isNull(), "-").when(F.col("old") != F.col("new"), "~").otherwise(" ")
    return j.select(key, "pos", "old", "new", change.alias("change"))


