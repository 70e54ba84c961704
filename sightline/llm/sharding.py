"""Balanced contiguous shards by global prefix sums of sizes. DataFrame expressions only.

Method. Rows are range-partitioned by id, so each partition is a stretch of the global
order. Every partition gives one total; the running sum of these few totals is where
its stretch begins. A running sum inside each partition then places every row in the
global order, and the order is cut where equal targets of bytes fall. No task sees more
than a partition, and only totals (a row per partition) meet in one place.

Defined results: null text has no bytes and size 1. Rows without an id come first.
Repeated ids and repeated rows are ordered by a number that each row gets when its
size is taken, so that a hot id is split like any other stretch. An empty table gives
no rows. A row belongs to the shard in which its middle byte falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import shared, table

SHARDS = 16


def contiguous_shards(rows: DataFrame, order: str, size: str, shards: int = SHARDS) -> DataFrame:
    """``rows`` plus ``shard`` and ``slot`` (place in the shard): contiguous in ``order``, bytes near equal."""
    spark = rows.sparkSession
    columns = rows.columns
    rows = shared(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = shared(rows.repartitionByRange(parts, F.col(order), F.col("_row")).withColumn("_part", F.spark_partition_id()), "shard-ranged")
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    # a row per partition: the only thing that meets in one task
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("_before"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_ahead"), F.sum("bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(F.col(order), F.col("_row"))
    placed = ranged.join(F.broadcast(base), "_part")
    start = F.col("_before") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size)
    placed = placed.select(*columns, (F.col("_ahead") + F.row_number().over(inside) - 1).alias("_at"), F.least(F.floor((2 * start + F.col(size)) * F.lit(shards) / (2 * F.col("_all"))), F.lit(shards - 1)).cast("int").alias("shard"))
    placed = shared(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(*columns, "shard", (F.col("_at") - F.col("_first")).cast("long").alias("slot"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus one), text_crc32."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contiguous_shards(sizes(table(spark, sf_dir, "documents")), "doc_id", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
