"""Structural JavaScript analysis of a capture: tokens, leads, notes, calls."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import flows, js, js_calls, js_structure
from sightline.plans.inventory import Inventory
from sightline.session import persist_table, shuffled


class Structural:
    """Runs once per distinct app body; the token table is written once and shared."""

    def __init__(self, inventory: Inventory):
        self.inventory = inventory

    @cached_property
    def bodies(self) -> DataFrame:
        return persist_table(self.inventory.kinds.where("deep").select("sha256", "seq", "url", "body"), "js-bodies")

    @cached_property
    def tokens(self) -> DataFrame:
        return persist_table(js_structure.tokens(self.bodies), "js-tokens")

    @cached_property
    def dom(self) -> tuple[DataFrame, DataFrame]:
        return js_structure.dom_flows(self.bodies, self.tokens)

    @cached_property
    def guard(self) -> tuple[DataFrame, DataFrame]:
        return js_structure.guard_pairs(self.bodies, self.tokens)

    @cached_property
    def argument(self) -> tuple[DataFrame, DataFrame]:
        return js_structure.argument_pairs(self.bodies, self.tokens)

    @cached_property
    def events(self) -> DataFrame:
        """Leads as finding events; each kind is written by a plan of its own."""
        out = []
        for k, (leads, _) in enumerate((self.dom, self.guard, self.argument)):
            j = leads.join(shuffled(self.bodies.select("sha256", "seq", F.col("url").alias("location"))), "sha256")
            order = F.pmod(F.xxhash64("type", "raw_match"), F.lit(100_000)).cast("int")
            rows = j.select("seq", (F.lit(6_000_000 + k * 100_000) + order).alias("ord"), "type", "severity", "raw_match", "location", "evidence", F.lit(False).alias("sensitive"))
            out.append(persist_table(rows, "seen-script-leads"))
        return reduce(lambda a, b: a.unionByName(b), out)

    def notes(self) -> DataFrame:
        """sha256, note: structural notes first, then flat ones."""
        from pyspark.sql import Window as W

        parts = [n.select("sha256", (F.lit(k * 10_000_000) + F.col("ord")).cast("bigint").alias("ord"), "note") for k, (_, n) in enumerate((self.dom, self.guard, self.argument))]
        parts.append(js.flat_notes(self.inventory.kinds).select("sha256", (F.col("ord") + 100_000_000).cast("bigint").alias("ord"), "note"))
        u = reduce(lambda a, b: a.unionByName(b), parts)
        w = W.partitionBy("sha256").orderBy("ord", "note")
        return u.withColumn("rn", F.row_number().over(w)).select("sha256", "rn", "note")

    @cached_property
    def calls(self) -> DataFrame:
        d = js_calls.client_calls(self.bodies, self.tokens)
        j = d.join(shuffled(self.bodies.select("sha256", "seq", F.col("url").alias("js_url"))), "sha256")
        return persist_table(j.withColumnRenamed("call", "ord"), "js-sightings")

    @cached_property
    def flows(self) -> DataFrame:
        return flows.with_type(flows.rollup(self.calls), flows.keys(self.calls))
