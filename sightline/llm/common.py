"""Helpers shared by the training-data operators: reading, shared tables and components of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import persist_table

#: Rows that one Arrow batch may hold, so that a batch of very long texts stays small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str, folder: str | None = None) -> str:
    """Where a vocabulary file lies on this machine: in ``folder``, or where the installed package has it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small; a smaller value that the session has is left."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage."""
    return persist_table(df, name)


def node_id(doc_id: Column, text: Column) -> Column:
    """``doc_id`` as a long; rows without one get a negative number made from their text."""
    return F.coalesce(doc_id.cast("long"), -F.abs(F.shiftrightunsigned(F.xxhash64(text), 2)) - F.lit(1))


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Label every node of an undirected edge list: ``node``, ``label`` (smallest node reachable).

    Every round hooks each node on its neighbour of smallest hashed priority and
    contracts the edges; hashing the priorities makes long chains shrink by a
    constant share a round. Both the hooks and the edges are tables in the shared
    folder, so nothing is collected, and a hub is only ever aggregated by ``min``.
    Nodes that occur in self-loops only are labelled with themselves.
    """
    spark = edges.sparkSession
    edges = shared(edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "cc-edges")
    hooks: list[DataFrame] = []
    live = edges.where("a <> b")
    seed = 0
    while not live.isEmpty():
        seed += 1
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("p"), F.col(c).alias("v"))
        hook = shared(both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a")))["v"].alias("up")), "cc-hook")
        hooks.append(hook)
        moved = live.join(hook.select(F.col("a"), F.col("up").alias("ua")), "a").join(hook.select(F.col("a").alias("b"), F.col("up").alias("ub")), "b")
        moved = moved.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        live = shared(moved, "cc-live")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    out = nodes.withColumn("root", F.col("node"))
    for hook in hooks:
        out = out.join(hook.select(F.col("a").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    out = shared(out, "cc-roots")
    # written first: a component may hold a third of all nodes, and only a join of plain exchanges splits a skewed side
    least = shared(out.groupBy("root").agg(F.min("node").alias("label")), "cc-least")
    return shared(out.join(least, "root").select("node", "label"), "cc-labels") if hooks else out.select("node", F.col("root").alias("label"))
