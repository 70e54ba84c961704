"""Comparison of stored replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import nz, rl
from sightline.rules import packs

SAME_AT = 0.90
BASELINE = "original"
OUTCOMES = ["SAME", "BLOCKED", "DIFFERENT", "ERROR", "NONE"]


def normalize_body(body: Column) -> Column:
    """Long hex runs and long numbers change from answer to answer."""
    t = F.regexp_replace(nz(body), r"(?i)[0-9a-f-]{32,80}", "#")
    return F.regexp_replace(t, r"\d{8,40}", "0")


def tokens(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[\r\n,;{}\[\]<>]+"), lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def similarity_columns(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """Length ratio times token-set Jaccard of two text columns of the same row."""
    df = df.withColumn("_a", normalize_body(F.col(a))).withColumn("_b", normalize_body(F.col(b)))
    df = df.withColumn("_ta", tokens(F.col("_a"))).withColumn("_tb", tokens(F.col("_b")))
    la, lb = F.length("_a"), F.length("_b")
    both = F.size(F.array_intersect("_ta", "_tb"))
    union = F.size("_ta") + F.size("_tb") - both
    ratio = F.least(la, lb) / F.greatest(la, lb)
    sim = (
        F.when((la == 0) & (lb == 0), F.lit(1.0))
        .when((la == 0) | (lb == 0), F.lit(0.0))
        .when(union == 0, ratio)
        .otherwise(ratio * (both / union))
    )
    return df.withColumn(out, sim).drop("_a", "_b", "_ta", "_tb")


def compare(replays: DataFrame) -> DataFrame:
    """Verdict of each replay against the captured original."""
    st, ost = F.coalesce("status", F.lit(0)), F.coalesce("orig_status", F.lit(0))
    df = similarity_columns(replays, "orig_body", "body")
    na = (st == 0) | (ost == 0)
    blocked = st.isin(401, 403) | (st.between(300, 399) & (st != ost) & rl(F.col("location"), packs.LOGIN_LOCATION))
    verdict = (
        F.when(na, F.lit("NA")).when(blocked, F.lit("BLOCKED"))
        .when((st == ost) & (F.col("similarity") >= SAME_AT), F.lit("SAME")).otherwise(F.lit("DIFFERENT"))
    )
    df = df.withColumn("verdict", verdict)
    df = df.withColumn("similarity", F.when(F.col("verdict") == "NA", F.lit(-1.0)).otherwise(F.col("similarity")))
    outcome = F.when(F.col("error").isNotNull(), F.lit("ERROR")).when(F.col("verdict") == "NA", F.lit("NONE")).otherwise(F.col("verdict"))
    return df.withColumn("length_delta", F.coalesce("length", F.lit(0)) - F.coalesce("orig_length", F.lit(0))).withColumn("outcome", outcome)


def cells(compared: DataFrame) -> DataFrame:
    """Latest result per (target, identity); among equal times the later run."""
    identity = F.when(nz(F.col("identity")) == "", F.lit("Custom")).otherwise(F.col("identity"))
    last = F.max(F.struct("ts", "run_id", "outcome", "status", "method", "host", "path", "similarity")).alias("c")
    return compared.groupBy("target_key", identity.alias("identity")).agg(last).select(
        "target_key", "identity", F.col("c.method").alias("method"), F.col("c.host").alias("host"), F.col("c.path").alias("path"),
        F.col("c.ts").alias("ts"), F.col("c.status").alias("status"), F.col("c.outcome").alias("outcome"), F.col("c.similarity").alias("similarity"),
    )


def is_baseline(identity: Column) -> Column:
    return F.lower(identity) == BASELINE


def cell_text(outcome: Column, status: Column, identity: Column) -> Column:
    st = F.when(F.coalesce(status, F.lit(0)) == 0, F.lit("")).otherwise(status.cast("string"))
    label = F.when(outcome == "SAME", F.lit("⚠ Same")).when(outcome == "BLOCKED", F.lit("Blocked")).when(outcome == "DIFFERENT", F.lit("Different"))
    return (
        F.when(outcome == "ERROR", F.lit("Error"))
        .when(is_baseline(identity) | (outcome == "NONE"), st)
        .otherwise(F.trim(F.concat(st, F.lit(" "), nz(label))))
    )


def matrix(cell_rows: DataFrame, identities: list[str]) -> DataFrame:
    """One row per target, one column per identity."""
    df = cell_rows.withColumn("text", cell_text(F.col("outcome"), F.col("status"), F.col("identity")))
    return df.groupBy("target_key").pivot("identity", identities).agg(F.first("text"))


def matrix_filter(cell_rows: DataFrame, outcomes) -> DataFrame:
    """Targets of which any non-baseline cell has one of the outcomes; none given: all."""
    if not outcomes:
        return cell_rows
    hit = cell_rows.where(~is_baseline(F.col("identity")) & F.col("outcome").isin(list(outcomes))).select("target_key").distinct()
    return cell_rows.join(hit, "target_key", "left_semi")


def suspicious(cell_rows: DataFrame) -> DataFrame:
    return matrix_filter(cell_rows, ["SAME"]).select("target_key").distinct()


def matrix_counts(cell_rows: DataFrame) -> DataFrame:
    kept = cell_rows.where(~is_baseline(F.col("identity")) | (F.col("outcome") == "ERROR"))
    n = kept.groupBy("outcome").agg(F.count("*").alias("n"))
    dim = cell_rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(o) for o in OUTCOMES])).alias("outcome"))
    return dim.join(n, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))
