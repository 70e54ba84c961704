"""Marts over the rolled-up tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import classify, urls
from sightline.functions.text import first_match, nz, ordinal
from sightline.rules import js_packs, packs
from sightline.schemas import CATEGORIES, SEVERITIES
from sightline.session import shuffled

_SEV_COLS = [("HIGH", "high"), ("MEDIUM", "medium"), ("LOW", "low"), ("INFO", "info")]


def _sev_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(c) for s, c in _SEV_COLS]


def _score() -> Column:
    return F.col("high") * 100 + F.col("medium") * 10 + F.col("low")


def _per_host(df: DataFrame, *aggs: Column) -> DataFrame:
    return df.groupBy(urls.host_label(nz(F.col("host"))).alias("host")).agg(*aggs)


def _stack(*parts: DataFrame) -> DataFrame:
    """Union of per-host partial counts: cheaper than a chain of full outer joins, because
    every part is already one row per host."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def host_scorecard(eps: DataFrame, params: DataFrame, findings: DataFrame, tech: DataFrame) -> DataFrame:
    parts = _stack(
        _per_host(eps, F.count("*").alias("endpoints")),
        _per_host(params, F.count("*").alias("parameters")),
        _per_host(findings, *_sev_counts()),
        _per_host(tech, F.max(F.size("missing_headers")).cast("bigint").alias("missing_headers")),
    )
    cols = ["endpoints", "parameters", "high", "medium", "low", "info", "missing_headers"]
    out = parts.groupBy("host").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])
    return out.withColumn("score", _score()).orderBy(F.desc("score"), F.desc("endpoints"), "host")


def host_risk(eps: DataFrame, findings: DataFrame) -> DataFrame:
    parts = _stack(_per_host(eps, F.count("*").alias("endpoints")), _per_host(findings, *_sev_counts()))
    out = parts.groupBy("host").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("endpoints", "high", "medium", "low", "info")]
    )
    return out.withColumn("score", _score()).orderBy(F.desc("score"), F.desc("endpoints"), "host")


def findings_by_severity(findings: DataFrame) -> DataFrame:
    n = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return _dim(findings, "severity", SEVERITIES).join(n, "severity", "left").select(
        "severity", F.coalesce("n", F.lit(0)).alias("n")
    ).orderBy(ordinal(F.col("severity"), SEVERITIES))


def findings_by_category(findings: DataFrame) -> DataFrame:
    per_type = findings.groupBy("type").agg(F.count("*").alias("n"))
    n = per_type.groupBy(classify.category(F.col("type")).alias("category")).agg(F.sum("n").alias("n"))
    return _dim(findings, "category", CATEGORIES).join(n, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("n")
    ).orderBy(ordinal(F.col("category"), CATEGORIES))


def _dim(df: DataFrame, column: str, values) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))


def top_types(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def js_risk(findings: DataFrame) -> DataFrame:
    """Findings and weighted score per location."""
    w = first_match([(F.col("severity") == "HIGH", 10), (F.col("severity") == "MEDIUM", 4), (F.col("severity") == "LOW", 1)], 0)
    bonus = F.when(F.col("type").startswith("DOM XSS:"), 5).otherwise(0)
    return findings.where(F.col("location").isNotNull()).groupBy("location").agg(
        F.count("*").alias("findings"), F.sum(w + bonus).alias("score")
    )


def with_risk(df: DataFrame, risk: DataFrame, column: str = "url") -> DataFrame:
    r = risk.select(F.col("location").alias(column), F.col("findings").alias("finding_count"), F.col("score").alias("risk"))
    return df.join(shuffled(r), column, "left").fillna(0, ["finding_count", "risk"])


def path_note(path: Column) -> Column:
    p = F.lower(nz(path))
    return first_match([
        (p.contains("admin"), "admin path"), (p.contains("graphql"), "graphql"), (p.contains("actuator"), "actuator"),
        (p.contains("internal"), "internal path"), (p.contains("/api") | p.contains("swagger") | p.contains("api-docs"), "api"),
    ])


NOTABLE = 60


def notable_endpoints(eps: DataFrame, ep_params: DataFrame, top: int = NOTABLE) -> DataFrame:
    """Endpoints with risky parameter names or a telling path; the ``top`` with most classes.

    Names are classified once per distinct name, not once per row.
    """
    names = ep_params.select("name").distinct().select("name", F.explode(classify.name_classes(F.col("name"))).alias("cls"))
    names = names.where(F.col("cls").isin(packs.RISKY_CLASSES))
    # At most six distinct classes per endpoint reach the set.
    risky = ep_params.join(names, "name").groupBy("method", "normalized_url").agg(F.array_sort(F.collect_set("cls")).alias("classes"))
    rows = eps.join(risky, ["method", "normalized_url"], "left").select(
        "method", "normalized_url", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), path_note(F.col("path")).alias("note")
    ).where((F.size("classes") > 0) | F.col("note").isNotNull())
    why = F.concat_ws("; ", F.when(F.size("classes") > 0, F.array_join("classes", ", ")), F.col("note"))
    return rows.select("method", "normalized_url", why.alias("why"), F.size("classes").cast("bigint").alias("class_count")).orderBy(
        F.desc("class_count"), "normalized_url", "method"
    ).limit(top)


def parameter_classes(params: DataFrame) -> DataFrame:
    """Distinct (name, value kind) classified once, then joined back."""
    p = params.withColumn("value_kind", classify.value_kind(F.col("example")))
    dim = p.select("name", "value_kind").distinct().withColumn("classes", classify.classes(F.col("name"), F.col("value_kind")))
    return p.join(dim, ["name", "value_kind"])


def class_summary(params: DataFrame) -> DataFrame:
    return parameter_classes(params).select(F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("n")).orderBy("class")


def js_summary(rows: DataFrame) -> DataFrame:
    """Distinct files and findings per category of JavaScript findings."""
    c = rows.select(classify.category(F.col("type")).alias("category"), urls.js_file_label(F.col("location")).alias("file"))
    per = c.groupBy("category").agg(F.count("*").alias("n"))
    files = c.agg(F.count_distinct("file").alias("n")).select(F.lit("(files)").alias("category"), "n")
    return files.unionByName(per)


def report_summary(ex_count: DataFrame, **tables: DataFrame) -> DataFrame:
    rows = [ex_count.agg(F.count("*").alias("n")).select(F.lit("requests").alias("section"), "n")]
    rows += [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("section"), "n") for k, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


BAR_ROWS = 8


def top_bars(counts: DataFrame, column: str, rows: int = BAR_ROWS) -> DataFrame:
    """The ``rows`` largest counts with their share of the largest, at least 2 percent."""
    top = counts.orderBy(F.desc("n"), column).limit(rows)
    most = counts.agg(F.max("n")).scalar()
    return top.select(column, "n", F.greatest(F.lit(2), F.floor(F.lit(100) * F.col("n") / most)).cast("bigint").alias("percent"))


def seen_flag(findings: DataFrame, eps: DataFrame, params: DataFrame) -> DataFrame:
    """Whether a route or parameter found in code ever occurred in traffic; NULL for other types."""
    paths = eps.where(F.col("last_status") != 0).select(urls.route_path(F.col("path")).alias("_k")).distinct().withColumn("_hit_p", F.lit(True))
    names = params.select(F.col("name").alias("_k")).distinct().withColumn("_hit_n", F.lit(True))
    route = F.col("type").startswith(js_packs.ROUTE_PREFIX)
    hidden = F.col("type").startswith(js_packs.HIDDEN_PARAM_PREFIX)
    f = findings.withColumn(
        "_k", F.when(route, F.concat(F.lit("p"), urls.route_path(F.col("raw_match")))).when(hidden, F.concat(F.lit("n"), F.col("raw_match")))
    )
    keys = paths.select(F.concat(F.lit("p"), F.col("_k")).alias("_k")).unionByName(names.select(F.concat(F.lit("n"), F.col("_k")).alias("_k"))).withColumn("_hit", F.lit(True))
    # Findings of other types have no key: they are kept out of the join, where they would
    # all meet in one NULL partition.
    looked = f.where(F.col("_k").isNotNull()).join(shuffled(keys), "_k", "left").withColumn("seen", F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")
    other = f.where(F.col("_k").isNull()).drop("_k").withColumn("seen", F.lit(None).cast("boolean"))
    return looked.unionByName(other)


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings as a report shows them: the raw match stays behind."""
    return findings.select(
        "type", classify.category(F.col("type")).alias("category"), "severity", F.col("masked").alias("value"), "location", "evidence", "times_seen",
    )


def ranked(risk: DataFrame) -> DataFrame:
    """``risk`` with the dense ``rank`` of its score. Only the distinct scores, which are small whole numbers, meet in one window."""
    from pyspark.sql import Window as W

    scores = risk.select("score").distinct()
    place = scores.withColumn("rank", F.dense_rank().over(W.orderBy(F.desc("score"))).cast("bigint"))
    return risk.join(place, "score")
