"""Places in nested text: the nearest enclosing bracket with a property, and the next token with one.

Both work on whole bodies without a bound on depth or distance. Enclosing brackets are found
by pointer doubling: every round a bracket that has no answer yet takes its parent's, or the
parent's own pointer, so the distance covered doubles and the rounds are the logarithm of the
depth, while the table stays as long as the brackets. The next token is an as-of look-up:
places and tokens in one order, the token carried back to the places before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.session import persist_table, shuffled


def nearest(tree: DataFrame, marks: list[str], node: str = "node", up: str = "up", by: str = "sha256") -> DataFrame:
    """``tree`` (by, node, up, marks; up is null or negative at the top) with each mark filled from the
    nearest enclosing node that has one, the node itself first."""
    c = F.col
    cur = persist_table(tree.select(by, node, F.when(c(up) >= 0, c(up)).alias(up), *marks), "nesting")
    while True:
        open_ = reduce(lambda a, b: a | b, [c(m).isNull() for m in marks]) & c(up).isNotNull()
        if cur.where(open_).isEmpty():
            return cur.select(by, node, *marks)
        above = cur.select(c(by), c(node).alias(up), c(up).alias("_up"), *[c(m).alias(f"_{m}") for m in marks])
        step = cur.join(shuffled(above), [by, up], "left")
        # a pointer that met nothing above leaves the tree
        cur = persist_table(step.select(by, node, c("_up").alias(up), *[F.coalesce(c(m), c(f"_{m}")).alias(m) for m in marks]), "nesting")


def next_after(places: DataFrame, tokens: DataFrame, at: str, payload: Column, name: str, by: list[str], where: str = "i") -> DataFrame:
    """``places`` plus ``name``: ``payload`` of the first of ``tokens`` that stands at or after ``at`` (null without one)."""
    t = tokens.select(*by, F.col(where).cast("long").alias("_k"), payload.alias("_tk"))
    p = places.select(*by, F.col(at).cast("long").alias("_k"), F.struct(*places.columns).alias("_pl"))
    u = p.unionByName(t, allowMissingColumns=True)
    # read from the end: a token at the same place comes before the places that ask
    w = W.partitionBy(*by).orderBy(F.desc("_k"), F.col("_pl").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    u = u.withColumn("_nx", F.last("_tk", True).over(w)).where(F.col("_pl").isNotNull())
    return u.select("_pl.*", F.col("_nx").alias(name))
