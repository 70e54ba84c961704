"""Structured Streaming jobs.

Each job takes a streaming DataFrame of exchanges.  Results are written to tables in the
shared folder: nothing is collected by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline.functions import urls
from sightline.operators import detect, js, jwt, rollup
from sightline.plans.inventory import Inventory
from sightline.session import persist_table, scratch_path, scratch_run
from sightline.streaming.table import LogTable


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None, trigger: dict | None = None) -> DataFrame:
    """Drain what is available into a parquet table and read that.

    ``path`` holds the table and the stream's checkpoint: a second run with the same one
    goes on where the first ended. Without it a fresh folder is taken.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


# --- the inventory, batch by batch ---


def _counter_parts(inv: Inventory) -> DataFrame:
    status, host, ctype = rollup.counters(inv.prepared)
    rows = [status.select(F.lit("status").alias("by"), F.col("status").cast("string").alias("value"), "n"), host.select(F.lit("host").alias("by"), F.col("host").alias("value"), "n"), ctype.select(F.lit("type").alias("by"), F.col("content_type").alias("value"), "n")]
    return reduce(lambda a, b: a.unionByName(b), rows)


def _host_status_parts(inv: Inventory) -> DataFrame:
    return inv.captured.where(F.col("status") > 0).groupBy("host", "status").agg(F.count("*").alias("n"))


def _script_parts(inv: Inventory) -> DataFrame:
    return inv.bodies.select("sha256", F.struct("seq", "url").alias("first"), F.length("body").alias("size"), urls.host_of(F.col("url")).alias("host"))


def _finding_parts(inv: Inventory) -> DataFrame:
    """All detectors but those of tokens, which have a table of their own; scripts only where a body is new."""
    events = inv.plain_events.unionByName(inv.description_events)
    return rollup.finding_parts(events if inv.bodies.isEmpty() else events.unionByName(inv.js_events))


@dataclass(frozen=True)
class Kept:
    """How a table is kept: its key, the partial rows of a batch, how partial rows merge, the host column and what is capped."""

    keys: tuple[str, ...]
    parts: Callable[[Inventory], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    host: str | None = "host"
    order: str | None = None
    tie: str | None = None


def _summed(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.groupBy(*keys).agg(F.sum("n").alias("n"))


TABLES = {
    "endpoints": Kept(("method", "normalized_url"), lambda i: rollup.endpoints(i.all_endpoint_events), rollup.merge_parts, order="first_seq", tie="normalized_url"),
    "parameters": Kept(("endpoint_key", "location", "name"), lambda i: rollup.parameter_parts(i.all_parameter_events), rollup.merge_parameter_parts),
    "findings": Kept(("type", "raw_match"), _finding_parts, rollup.merge_finding_parts),
    "token_issues": Kept(("host", "label"), lambda i: jwt.first_issues(jwt.issues(jwt.tokens(i.prepared))), jwt.first_issues),
    "technologies": Kept(("host", "technology"), lambda i: i.tech_rows, lambda d: d.distinct()),
    "scripts": Kept(("sha256",), _script_parts, lambda d: d.groupBy("sha256").agg(F.min("first").alias("first"), F.max("size").alias("size"), F.min("host").alias("host"))),
    # counters stay when a host is deleted
    "counters": Kept(("by", "value"), _counter_parts, _summed("by", "value"), host=None),
    "host_status": Kept(("host", "status"), _host_status_parts, _summed("host", "status"), host=None),
}


class StreamState:
    """The tables of a capture as a stream keeps them, under one folder."""

    def __init__(self, spark: SparkSession, path: str, cap: int = 0, tables: Iterable[str] = tuple(TABLES)):
        self.spark, self.path = spark, path
        self.tables = {n: LogTable(spark, f"{path}/{n}", list(k.keys), k.merge, k.host, cap if k.order else 0, k.order or "", k.tie) for n, k in TABLES.items() if n in tables}

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Analyse a batch once and commit its part of every table. Scripts go last: they tell which bodies are new."""
        spark = batch.sparkSession
        with scratch_run(spark):
            seen = self.tables["scripts"].partials() if "scripts" in self.tables else None
            # read once from the source: several tables need passes of their own
            inv = Inventory(persist_table(batch, "batch"), known=seen)
            for name in sorted(self.tables, key=lambda n: n == "scripts"):
                table = self.tables[name]
                if batch_id > table.manifest()["batch"]:
                    table.append(TABLES[name].parts(inv), batch_id)

    def run(self, stream: DataFrame) -> StreamState:
        """Drain what is available; a second run with the same folder goes on where the first ended."""
        q = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return self

    def delete_hosts(self, hosts: DataFrame) -> None:
        """Hosts leave every table but the counters; exchanges that come later count from the start."""
        for table in self.tables.values():
            table.delete(hosts)

    def table(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def findings(self) -> DataFrame:
        """Findings of all detectors, with those of tokens."""
        parts = self.tables["findings"].partials().unionByName(rollup.finding_parts(jwt.issue_events(self.table("token_issues"))))
        return rollup.finished_findings(rollup.merge_finding_parts(parts))

    def parameters(self) -> DataFrame:
        return rollup.finished_parameters(self.table("parameters"))


def _state(stream: DataFrame, name: str, path: str | None, *tables: str, cap: int = 0) -> StreamState:
    spark = stream.sparkSession
    return StreamState(spark, path or scratch_path(spark, name), cap, tables).run(stream)


def upsert_endpoints(stream: DataFrame, cap: int = 0, path: str | None = None) -> DataFrame:
    """Endpoint rollup kept up to date batch by batch; with a cap only the newest stay."""
    return _state(stream, "stream-endpoints", path, "endpoints", cap=cap).table("endpoints")


def finding_counts(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Running count per finding, of all detectors."""
    return _state(stream, "stream-findings", path, "findings", "token_issues", "scripts").findings()


def status_counters(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Running counters per host and status."""
    return _state(stream, "stream-counters", path, "host_status").table("host_status")


# --- each once, until it is gone ---


class _Once(StatefulProcessor):
    """Lets a member through once per key, and again after its key was deleted or its time is up."""

    def __init__(self, keep_hours: int):
        self.keep = keep_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "member string", "seq long", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out = []
            for member, seq, deleted in frame.sort_values(["seq"])[["member", "seq", "deleted"]].itertuples(index=False):
                if deleted:
                    self.seen.clear()
                elif not self.seen.containsKey((member,)):
                    self.seen.updateValue((member,), (int(seq),))
                    out.append((key[0], member, int(seq)))
            yield pd.DataFrame(out, columns=["key", "member", "seq"]).astype({"seq": "int64"})

    def close(self) -> None:
        pass


def _first_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within a task only the first of equal rows goes on, so that a hot key sends few."""
    for b in batches:
        yield b.sort_values("seq", kind="stable").drop_duplicates(["key", "member", "deleted"] if not b["deleted"].any() else ["key", "member", "deleted", "seq"])


def once(rows: DataFrame, deletions: DataFrame | None, name: str, path: str | None = None, keep_hours: int = 24 * 365) -> DataFrame:
    """``rows`` (key, member, seq) as a stream, each member of a key once until ``deletions`` (key, seq) names the key.

    State is one entry per member, given up after ``keep_hours`` without it having been let through again.
    """
    spark = rows.sparkSession
    every = rows.select("key", "member", "seq", F.lit(False).alias("deleted"))
    if deletions is not None:
        every = every.unionByName(deletions.select("key", F.lit(None).cast("string").alias("member"), "seq", F.lit(True).alias("deleted")))
    schema = "key string, member string, seq long, deleted boolean"
    few = every.mapInPandas(_first_of_each, schema)
    out = few.groupBy("key").transformWithStateInPandas(_Once(keep_hours), "key string, member string, seq long", "Append", "ProcessingTime")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # State with a lifetime asks for a further batch at any time, so a drain that goes on until none is due would not end.
    return run_to_table(out, name, path=path, trigger={"once": True})


def new_js_bodies(stream: DataFrame, path: str | None = None, keep_hours: int = 24 * 365) -> DataFrame:
    """First sighting of every JavaScript body; state holds one hash per body for ``keep_hours``."""
    rows = js.js_responses(detect.prepare(stream)).withColumn("sha256", F.sha2("body", 256))
    rows = rows.select(F.col("sha256").alias("key"), F.length("body").cast("string").alias("member"), "seq")
    return once(rows, None, "stream-js", path, keep_hours).select(F.col("key").alias("sha256"), F.col("member").cast("int").alias("size"))


def token_issues(stream: DataFrame, deletions: DataFrame | None = None, path: str | None = None, keep_hours: int = 24 * 365) -> DataFrame:
    """(host, issue) as tokens show them, each emitted once, and again after the host was deleted (``deletions``: host, seq)."""
    rows = jwt.issues(jwt.tokens(detect.prepare(stream))).select(F.col("host").alias("key"), F.col("label").alias("member"), F.col("m.seq").alias("seq"))
    gone = None if deletions is None else deletions.select(F.lower("host").alias("key"), "seq")
    return once(rows, gone, "stream-jwt", path, keep_hours).select(F.col("key").alias("host"), F.col("member").alias("issue"), "seq")


def traffic_windows(ex: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and errors per time window and host; the same plan for batch and stream."""
    w = ex.withWatermark("observed_at", late).groupBy(F.window("observed_at", width).alias("w"), "host").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors")
    )
    return w.select(F.col("w.start").alias("window_start"), "host", "requests", "errors")


def traffic_sessions(ex: DataFrame, client, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a client key by inactivity gap."""
    s = ex.withColumn("client", client).where(F.col("client").isNotNull()).withWatermark("observed_at", late).groupBy(
        F.session_window("observed_at", gap).alias("w"), "client"
    ).agg(F.count("*").alias("requests"))
    return s.select("client", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests")
