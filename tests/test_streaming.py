"""Streams that end and go on equal one batch over everything."""

import random

import pytest
from pyspark.sql import functions as F

from sightline import schemas
from sightline.operators import detect, filters, rollup
from sightline.plans.inventory import Inventory
from sightline.session import names
from sightline.sources import adapters, readers
from sightline.streaming import jobs
from sightline.streaming.table import LogTable

SF = "/root/testdata/sf0.001"
ENDPOINT = ["method", "normalized_url", "observations", "last_status", "first_seq", "auth_status"]
FINDING = ["type", "raw_match", "severity", "times_seen", "first_seq", "location"]


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def test_all_tables_and_detectors_equal_one_batch(spark, tmp_path):
    columns = [f.name for f in schemas.EXCHANGES]
    ex = adapters.capture(spark, SF, "events", "scripts", "specs").select(columns).where("seq % 4 = 0")
    folder, state = str(tmp_path / "capture"), str(tmp_path / "state")
    middle = ex.approxQuantile("seq", [0.5], 0.01)[0]
    for part in (ex.where(F.col("seq") <= middle), ex.where(F.col("seq") > middle)):
        part.coalesce(1).write.mode("append").parquet(folder)
        kept = jobs.StreamState(spark, state).run(readers.stream_exchanges(spark, folder))
    inv = Inventory(ex)
    assert sorted_rows(kept.table("endpoints").select(ENDPOINT)) == sorted_rows(rollup.endpoints(inv.all_endpoint_events).select(ENDPOINT))
    assert sorted_rows(kept.parameters()) == sorted_rows(rollup.parameters(inv.all_parameter_events).select(kept.parameters().columns))
    got, want = (sorted_rows(f.select(FINDING)) for f in (kept.findings(), rollup.findings(inv.all_events)))
    assert got == want and len({r.split(",")[0] for r in got}) > 30
    assert sorted_rows(kept.table("technologies")) == sorted_rows(inv.tech_rows)
    assert kept.table("scripts").count() == inv.bodies.count()
    counts = ex.where("status > 0").groupBy("host", "status").agg(F.count("*").alias("n"))
    assert sorted_rows(kept.table("host_status")) == sorted_rows(counts)
    # nothing new: a further run changes nothing
    again = jobs.StreamState(spark, state).run(readers.stream_exchanges(spark, folder))
    assert sorted_rows(again.table("endpoints").select(ENDPOINT)) == sorted_rows(kept.table("endpoints").select(ENDPOINT))
    # deleted hosts leave all tables but the counters
    host = inv.tech.orderBy("host").first()["host"]
    again.delete_hosts(spark.createDataFrame([(host,)], "host string"))
    for name in ("endpoints", "parameters", "findings", "technologies", "scripts", "token_issues"):
        assert again.table(name).where(F.col("host") == host).isEmpty(), name
    assert sorted_rows(again.table("host_status")) == sorted_rows(counts)


def parts(spark, rows):
    return spark.createDataFrame(rows, "k string, host string, n long, first_seq long").groupBy("k", "host").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))


def merged(d):
    return d.groupBy("k").agg(F.min("host").alias("host"), F.sum("n").alias("n"), F.min("first_seq").alias("first_seq")).select("k", "host", "n", "first_seq")


def test_files_stay_few_and_batches_count_once(spark, tmp_path):
    t = LogTable(spark, str(tmp_path / "t"), ["k"], merged, "host", buckets=2, fan=4)
    rng, every = random.Random(4), []
    for batch in range(50):
        rows = [(f"k{rng.randrange(40)}", f"h{rng.randrange(3)}", 1, batch * 100 + j) for j in range(8)]
        rows = [(k, f"h{int(k[1:]) % 3}", n, q) for k, _, n, q in rows]
        every += rows
        t.append(parts(spark, rows).coalesce(1), batch)
        if batch % 17 == 0:
            t.append(parts(spark, rows), batch)  # a batch that runs again
        if batch == 30:
            t.delete(spark.createDataFrame([("h1",)], "host string"))
            every = [r for r in every if r[1] != "h1"]
    want = {}
    for k, h, n, q in every:
        old = want.get(k, (h, 0, q))
        want[k] = (h, old[1] + n, min(old[2], q))
    assert {r["k"]: (r["host"], r["n"], r["first_seq"]) for r in t.read().collect()} == want
    levels = t.manifest()["live"]
    assert max(len(own) for own in levels.values()) <= 3 * 4
    assert len(names(spark, f"{t.path}/data")) <= 2 * 3 * 4 and len([n for n in names(spark, t.path) if n.startswith("manifest-")]) <= 2


def test_eviction_keeps_the_newest(spark, tmp_path):
    t = LogTable(spark, str(tmp_path / "t"), ["k"], merged, "host", cap=10, tie="k", buckets=2, fan=3)
    for batch in range(9):
        t.append(parts(spark, [(f"k{batch * 6 + j:03}", "h", 1, batch * 6 + j) for j in range(6)]), batch)
    assert sorted(r["k"] for r in t.read().collect()) == [f"k{j:03}" for j in range(44, 54)]
    assert t.partials().count() <= 10 + 3 * 6


@pytest.mark.parametrize("ranked", [5, 100_000])
def test_newest_is_exact_with_ties_nulls_and_extremes(spark, monkeypatch, ranked):
    monkeypatch.setattr(filters, "RANKED", ranked)
    rng = random.Random(2)
    tables = {
        "ties": [(7 if rng.random() < 0.9 else rng.randrange(100), f"https://host.example/p/{rng.randrange(10**9)}") for _ in range(1500)],
        "wide": [(rng.randrange(-(2**62), 2**62), str(j)) for j in range(400)],
        "ends": [(2**63 - 1, "a"), (-(2**63) + 1, "b"), (0, "c"), (None, "d"), (None, "e")],
    }
    for rows in tables.values():
        df = spark.createDataFrame(rows, "o long, t string")
        for cap in (1, 3, 700):
            want = sorted(rows, key=lambda x: (-(x[0] if x[0] is not None else -(2**63)), x[1]))[:cap]
            assert sorted(map(str, filters.newest(df, cap, "o", "t").collect())) == sorted(f"Row(o={o}, t={t!r})" for o, t in want)


def test_token_issues_come_again_after_deletion(spark, tmp_path):
    state = str(tmp_path / "s")

    def run(seen, deleted):
        folders = {}
        for name, rows, schema in (("rows", seen, "key string, member string, seq long"), ("gone", deleted, "key string, seq long")):
            folders[name] = spark.createDataFrame(rows, schema)
            folders[name].coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = {n: spark.readStream.schema(df.schema).parquet(str(tmp_path / n)) for n, df in folders.items()}
        return sorted((r["key"], r["member"], r["seq"]) for r in jobs.once(streams["rows"], streams["gone"], "x", state).collect())

    first = [("a", "alg=none", 1), ("b", "kid header", 2)]
    assert run([*first, ("a", "alg=none", 3)], []) == first
    assert run([("b", "alg=none", 4), ("a", "alg=none", 6)], [("a", 5)]) == [first[0], ("a", "alg=none", 6), ("b", "alg=none", 4), first[1]]


def test_counters_and_endpoints_resume(spark, tmp_path):
    ex = adapters.capture(spark, SF, "events").select([f.name for f in schemas.EXCHANGES])
    folder = str(tmp_path / "capture")
    run = lambda job, name: job(readers.stream_exchanges(spark, folder), path=str(tmp_path / name))
    for half in (ex.where("seq % 16 = 0"), ex.where("seq % 16 <> 0")):
        half.write.mode("append").parquet(folder)
        counts, ends = run(jobs.status_counters, "c"), run(jobs.upsert_endpoints, "e")
    assert sorted_rows(counts) == sorted_rows(ex.where("status > 0").groupBy("host", "status").agg(F.count("*").alias("n")))
    assert sorted_rows(ends.select(ENDPOINT)) == sorted_rows(rollup.endpoints(rollup.endpoint_events(detect.prepare(Inventory(ex).exchanges))).select(ENDPOINT))


def test_rows_of_a_stream_are_dealt_over_the_cores(spark, tmp_path):
    """The table is one row group; every batch is spread, and read from the source once however many tables it feeds."""
    from sightline.plans import queries

    seen = []

    def add(batch, _):
        seen.append([r["n"] for r in batch.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()])

    queries.events_stream(spark, SF).writeStream.foreachBatch(add).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    cores = spark.sparkContext.defaultParallelism
    assert len(seen) == 1 and len(seen[0]) >= cores and max(seen[0]) <= 2 * sum(seen[0]) / cores

    passes = spark.sparkContext.accumulator(0)

    def note(x):
        passes.add(1)
        return x

    rows = adapters.capture(spark, SF, "events").limit(50)
    noted = spark.createDataFrame(rows.rdd.map(note), rows.schema)
    jobs.StreamState(spark, str(tmp_path / "state"), tables=("endpoints", "host_status", "technologies")).add(noted, 0)
    assert passes.value == 50
