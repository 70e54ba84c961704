"""A table of partial rollups that a stream appends to.

Every commit writes one segment, cut into buckets by the key; reading merges what a bucket
holds. Merging is what the rollups do anyway (they name ``seq`` in every first/last rule),
so a table read after many batches equals one rollup of everything. A bucket that holds
``FAN`` parts of one level has them merged into one part of the next level: no other bucket
is rewritten, a row is rewritten once a level, and a bucket holds at most ``FAN - 1`` parts a
level, whatever number of batches came before.

The state is a manifest, a small file written whole: a batch that runs again finds its own
number there and does nothing, one that failed half-way overwrites its segment.

``delete`` notes hosts as tombstones: rows written before are hidden when read and dropped
when their bucket is next merged; rows of later batches count from the start. With a cap
only the newest rows stay: every ``FAN`` commits the table, which the cap bounds, is rewritten
with them alone, and a key that comes again afterwards starts anew.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.operators import filters
from sightline.session import names, read_text, remove, write_text

BUCKETS, FAN = 16, 8


class LogTable:
    def __init__(
        self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], host: str | None = None,
        cap: int = 0, order: str = "first_seq", tie: str | None = None, buckets: int = BUCKETS, fan: int = FAN,
    ):
        self.spark, self.path, self.keys, self.merge, self.host = spark, path.rstrip("/"), keys, merge, host
        self.cap, self.order, self.tie, self.buckets, self.fan = cap, order, tie, buckets, fan

    # --- manifest ---
    def _versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict:
        """live: bucket to its parts [segment, level]; tombstones: [name, last segment hidden]; batch: the last one committed."""
        versions = self._versions()
        if not versions:
            return {"live": {}, "tombstones": [], "batch": -1, "segment": 0, "schema": None}
        return json.loads(read_text(self.spark, f"{self.path}/manifest-{versions[-1]}.json"))

    def _commit(self, state: dict) -> None:
        versions = self._versions()
        write_text(self.spark, f"{self.path}/manifest-{(versions[-1] if versions else 0) + 1}.json", json.dumps(state))
        # a reader of the version before may still be at work; what neither names goes
        used = {f"s{seg}" for m in ([state, json.loads(read_text(self.spark, f"{self.path}/manifest-{versions[-1]}.json"))] if versions else [state]) for parts in m["live"].values() for seg, _ in parts}
        for name in names(self.spark, f"{self.path}/data"):
            if name not in used:
                remove(self.spark, f"{self.path}/data/{name}")
        for v in versions[:-1]:
            remove(self.spark, f"{self.path}/manifest-{v}.json")
        for name in set(names(self.spark, f"{self.path}/tombstones")) - {t[0] for t in state["tombstones"]}:
            remove(self.spark, f"{self.path}/tombstones/{name}")

    # --- reading ---
    def _parts(self, state: dict, parts: list[tuple[int, int]]) -> DataFrame:
        """Rows of (segment, bucket) pairs without what tombstones hide."""
        schema = _schema(state["schema"])
        out = []
        for seg in sorted({s for s, _ in parts}):
            rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/s{seg}/bucket={b}" for s, b in parts if s == seg))
            for name, last in state["tombstones"]:
                if seg <= last:
                    gone = self.spark.read.parquet(f"{self.path}/tombstones/{name}").select(F.col("host").alias(self.host))
                    rows = rows.join(gone, self.host, "left_anti")
            out.append(rows.select(schema.fieldNames()))
        return reduce(lambda a, b: a.unionByName(b), out)

    def partials(self) -> DataFrame | None:
        """All partial rows; None before the first commit."""
        state = self.manifest()
        parts = [(seg, int(b)) for b, own in state["live"].items() for seg, _ in own]
        if parts:
            return self._parts(state, parts)
        return self.spark.createDataFrame([], _schema(state["schema"])) if state["schema"] else None

    def read(self) -> DataFrame | None:
        rows = self.partials()
        return None if rows is None else filters.newest(self.merge(rows), self.cap, self.order, self.tie)

    # --- writing ---
    def _write(self, rows: DataFrame, seg: int) -> list[int]:
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", place).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/s{seg}")
        return [int(n.split("=")[1]) for n in names(self.spark, f"{self.path}/data/s{seg}") if n.startswith("bucket=")]

    def append(self, rows: DataFrame, batch: int) -> None:
        """Commit the partial rows of a batch, once however often it is called for it."""
        state = self.manifest()
        if batch <= state["batch"]:
            return
        state["segment"] += 1
        state["schema"] = json.loads(rows.schema.json())
        for b in self._write(rows, state["segment"]):
            state["live"].setdefault(str(b), []).append([state["segment"], 0])
        state["batch"] = batch
        if not self.cap:
            self._merge_full(state)
        elif max((len(p) for p in state["live"].values()), default=0) >= self.fan:
            self._evict(state)
        self._commit(state)

    def _merge_full(self, state: dict) -> None:
        while True:
            full = {b: level for b, own in state["live"].items() if (level := _full_level(own, self.fan)) is not None}
            if not full:
                break
            chosen = {b: [seg for seg, lv in state["live"][b] if lv == level] for b, level in full.items()}
            merged = self.merge(self._parts(state, [(seg, int(b)) for b, own in chosen.items() for seg in own]))
            state["segment"] += 1
            written = self._write(merged, state["segment"])
            for b, level in full.items():
                state["live"][b] = [p for p in state["live"][b] if p[1] != level] + ([[state["segment"], level + 1]] if int(b) in written else [])
        oldest = min((seg for own in state["live"].values() for seg, _ in own), default=0)
        state["tombstones"] = [t for t in state["tombstones"] if oldest <= t[1]]

    def _evict(self, state: dict) -> None:
        parts = [(seg, int(b)) for b, own in state["live"].items() for seg, _ in own]
        # the rollup is a table first: the rounds of the selection read it
        held = self.merge(self._parts(state, parts))
        state["segment"] += 1
        whole = f"{self.path}/data/s{state['segment']}"
        held.write.mode("overwrite").parquet(whole)
        kept = filters.newest(self.spark.read.schema(held.schema).parquet(whole), self.cap, self.order, self.tie)
        state["segment"] += 1
        state["live"] = {str(b): [[state["segment"], 0]] for b in self._write(kept, state["segment"])}
        state["tombstones"] = []

    def delete(self, hosts: DataFrame) -> None:
        """Hide the rows of these hosts from now on; their columns ``host``."""
        if self.host is None:
            return
        state = self.manifest()
        if not state["live"]:
            return
        name = f"t{state['segment']}-{len(state['tombstones'])}"
        hosts.select("host").where("host IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.path}/tombstones/{name}")
        state["tombstones"].append([name, state["segment"]])
        self._commit(state)


def _full_level(parts: list[list[int]], fan: int) -> int | None:
    """The lowest level of which a bucket holds ``fan`` parts."""
    many = Counter(level for _, level in parts)
    return min((level for level, n in many.items() if n >= fan), default=None)


def _schema(fields: dict) -> StructType:
    return StructType.fromJson(fields)
