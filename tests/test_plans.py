"""Rollup properties, round trips and some registered queries against their SQL."""

import json

import duckdb
import pytest
from conftest import row
from pyspark.sql import functions as F

from oracle.queries import SQL
from sightline.operators import detect, params, rollup
from sightline.plans.inventory import Inventory
from sightline.plans.queries import QUERIES
from sightline.rules import packs
from sightline.sources import adapters, readers, sinks

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_rollup_does_not_depend_on_order_or_batches(spark):
    ev = rollup.endpoint_events(detect.prepare(adapters.adapt(spark, SF, "events")))
    whole = rollup.endpoints(ev)
    shuffled = rollup.endpoints(ev.orderBy(F.rand(1)).repartition(7))
    assert rows(whole) == rows(shuffled)
    parts = rollup.merge_endpoints(rollup.endpoints(ev.where("seq % 3 = 0")), rollup.endpoints(ev.where("seq % 3 <> 0")))
    assert rows(whole.select(*parts.columns)) == rows(parts)


def test_state_round_trip(spark, tmp_path):
    i = Inventory(adapters.adapt(spark, SF, "pages"))
    sinks.export_state({"endpoints": i.endpoints}, str(tmp_path / "s"))
    assert rows(sinks.import_state(spark, str(tmp_path / "s"))["endpoints"]) == rows(i.endpoints)
    spark.createDataFrame([("other", 1, ["x"])], "format string, version int, tables array<string>").write.json(str(tmp_path / "t/_manifest.json"))
    with pytest.raises(ValueError):
        sinks.import_state(spark, str(tmp_path / "t"))


def test_rules_bodies_and_files(spark, tmp_path):
    rules, errors = readers.load_rules(spark, '{"patterns":[{"name":"a","regex":"x+"},{"name":"b","regex":"("},{"name":"c","regex":"(a+)+"}]}')
    assert [r.name for r in rules] == ["a"] and len(errors) == 2
    import gzip

    df = spark.createDataFrame([(1, bytearray(gzip.compress("é".encode())), "gzip", "text/html"), (2, bytearray(b"plain"), "gzip", ""), (3, bytearray(b"\xe9"), "", "text/html; charset=ISO-8859-1")], "i int, raw_body binary, content_encoding string, content_type string")
    assert {r["i"]: r["text"] for r in readers.normalise_bodies(df).collect()} == {1: "é", 2: "plain", 3: "é"}
    (tmp_path / "app.js").write_text("var a = 1;\nvar b;")
    f = readers.read_js_files(spark, str(tmp_path)).first()
    assert (f["url"], f["body"]) == ("import://app.js", "var a = 1;\nvar b;")


def test_report_hides_raw_matches(spark, tmp_path):
    i = Inventory(adapters.adapt(spark, SF, "documents"))
    sinks.write_report({"findings": i.findings}, str(tmp_path / "r"))
    assert "raw_match" not in spark.read.json(str(tmp_path / "r/findings")).columns


@pytest.mark.parametrize("rule", packs.SECRETS + packs.SIGNATURES + packs.AUTHZ, ids=lambda r: r.name)
def test_hostile_text_stays_cheap(spark, rule):
    import time

    text = "a" * 200_000 + " Warning: x " * 2000 + "java." * 5000 + "System." * 5000 + "a.b.c.dException" * 3000
    df = spark.createDataFrame([(text,)], "t string")
    start = time.time()
    df.select(F.size(F.regexp_extract_all("t", F.lit(rule.regex), F.lit(0)))).collect()
    assert time.time() - start < 10


CHECKED = ["endpoints", "cors_findings", "csrf_candidates", "jwt_weakness", "pii_card", "js_links", "replay_matrix", "diff_added", "cookie_parse", "value_kind"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    q = con.execute(SQL[name])
    names = [d[0] for d in q.description]
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    assert order == sorted(names)
    want = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in q.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want


def test_sources_of_one_capture_have_their_own_sequence_numbers(spark):
    from sightline.sources import adapters

    sf = "/root/testdata/sf0.001"
    seen = adapters.capture(spark, sf, "events", "pages", "documents", "scripts", "specs").groupBy("seq").count().where("count > 1")
    assert seen.isEmpty()


def test_inventory_holds_what_scripts_and_descriptions_name(spark):
    sf = "/root/testdata/sf0.001"
    sources = {x for r in QUERIES["merged_endpoints"](spark, sf).select("sources").distinct().collect() for x in r["sources"].split("|")}
    assert {"js", "spec", "graphql", "proxy"} <= sources
    types = {r["type"] for r in QUERIES["merged_findings"](spark, sf).collect()}
    assert any(t.startswith("DOM XSS:") for t in types) and {"API spec exposed", "GraphQL schema parsed", "CSRF candidate"} & types


def test_json_parameters_at_every_level(exchanges):
    deep = {"end": 7}
    for k in range(30):
        deep = {f"k{k}": deep if k % 3 else [[[deep, 1]]], "x": k}
    bodies = [deep, [[[[{"a": {"b": []}}]]]], {"e": {}, "n": None, "t": "{[", "f": [[[]]]}, [], 3, {"o": [{"p": 1}, {"q": 2}]}]

    def walk(level):
        out = []
        while level:
            inside = []
            for name, v in level:
                while isinstance(v, list) and v:
                    name, v = name + "[]", v[0]
                if isinstance(v, dict):
                    inside += [(f"{name}.{k}" if name else k, x) for k, x in sorted(v.items())]
            out += inside
            level = inside
        return [(n, "" if v is None or isinstance(v, (dict, list)) else str(v)) for n, v in out]

    df = exchanges(*[row(k, method="POST", req={"Content-Type": "application/json"}, req_body=json.dumps(b)) for k, b in enumerate(bodies)])
    got = params.json_params(detect.prepare(df)).orderBy("seq", "pos").collect()
    for k, b in enumerate(bodies):
        assert [(r["name"], r["value"]) for r in got if r["seq"] == k] == walk([("", b)])


def test_sarif_has_findings_and_flows(spark):
    from sightline.sources import sinks

    findings = spark.createDataFrame([("Secret", "HIGH", "raw", "r**", "https://h/x", "seen")], "type string, severity string, raw_match string, masked string, location string, evidence string")
    flows = spark.createDataFrame(
        [("Client Flow: IDOR candidate", "GET", "/a/{id}", "id", "https://h/a.js")], "type string, method string, path string, id_parameter string, js_url string"
    )
    rows = {r["rule_id"]: r for r in sinks.sarif_results(findings, flows).collect()}
    assert set(rows) == {"Secret", "Client Flow: IDOR candidate"}
    flow = rows["Client Flow: IDOR candidate"]
    assert flow["level"] == "warning" and flow["uri"] == "https://h/a.js" and flow["message"].startswith("GET /a/{id}")
    assert "raw" not in "".join(str(v) for v in rows["Secret"]) and len(rows["Secret"]["fingerprint"]) == 64


SCRIPT_QUERIES = [
    "client_flow_wrappers", "client_flows", "js_argument_pairs", "js_guard_pairs", "js_dom_flows", "js_noise", "js_risk", "js_sourced_findings", "client_flow_triggers",
    "flow_seen", "flow_template", "js_files_ranked", "nonlibrary_findings", "seen_flag", "untested_flows", "flow_summary", "js_asset_risk", "js_asset_detail",
    "js_findings_view", "js_summary",
]


def test_no_table_of_a_script_is_broadcast(spark, monkeypatch):
    """Neither by a query nor by a table written on its way: file sizes say little about what a table takes in the driver."""
    from pyspark.sql.readwriter import DataFrameWriter

    from sightline.plans import queries

    plans, write = [], DataFrameWriter.parquet

    def kept(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    queries.forget()
    for name in SCRIPT_QUERIES:
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        plans.append(f"{name}: " + df._jdf.queryExecution().executedPlan().toString())
    # the rank of a score is looked up in the distinct scores, which are small whole numbers
    found = [p for p in plans if "BroadcastHashJoin" in p and not p.startswith("js_files_ranked")]
    assert not found, found[0][:2000]


def test_one_row_group_is_dealt_over_the_cores(spark, tmp_path):
    """Its file has splits enough, but all rows are in one of them."""
    path = str(tmp_path / "one.parquet")
    spark.range(40_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["n"] for r in adapters.spread(df).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 40_000 / spark.sparkContext.defaultParallelism


def test_what_two_snapshots_share_is_analysed_once(spark, monkeypatch):
    from sightline.plans import queries
    from sightline.plans.inventory import Share, together

    ex = adapters.capture(spark, SF, "events")
    hour = F.hour("observed_at")
    early, shared = Share(ex.where(hour < 8)), Share(ex.where(hour.between(8, 15)))
    got, one = together(early, shared), Inventory(ex.where(hour < 16))
    assert rows(got["events"]) == rows(one.events)
    for name in ("endpoints", "parameters", "endpoint_params", "tech", "tech_rows"):
        want = getattr(one, name)
        assert rows(got[name].select(*want.columns)) == rows(want), name

    analysed, events = [], detect.events

    def counted(prepared, *settings):
        analysed.append(prepared.count())
        return events(prepared, *settings)

    monkeypatch.setattr(detect, "events", counted)
    queries._snapshots(spark, SF)
    assert sum(analysed) == Inventory(ex.where(hour.isNotNull())).prepared.count()


def test_what_scripts_and_descriptions_hold_is_analysed_once(spark):
    """What several sections of a report read is a written table: their plans go back to no capture and no token."""
    i = Inventory(adapters.capture(spark, SF, "scripts", "specs"))
    for events, tables in ((i.js_events, ("seen-script-findings-", "seen-script-leads-")), (i.description_events, ("operations-", "graphql-fields-"))):
        files = events.inputFiles()
        assert files and all(any(f"/{t}" in f for t in tables) for f in files), files[:3]


@pytest.mark.parametrize("name", ["events", "pages", "documents", "scripts", "specs"])
def test_conditions_are_tested_after_the_rows_are_dealt(spark, name):
    """The few tasks that read a file build no column for a condition on it."""
    plan = adapters.adapt(spark, SF, name).where("url LIKE '%q=%' AND resp_body LIKE '%a%'")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition")
    assert "Filter" in above and "Filter" not in below


def test_a_report_lists_the_technologies_of_a_host(spark, exchanges, monkeypatch):
    """Sorted, each once, beside the missing headers of the latest page; hosts with none of them are listed too."""
    from sightline.plans import queries

    html = {"ct": "text/html", "body": "<script src='/jquery-3.6.0.min.js'></script>"}
    ex = exchanges(
        row(1, url="https://a.example/", resp={"Server": "nginx"}, **html),
        row(2, url="https://a.example/x", resp={"Server": "Apache", "X-Frame-Options": "DENY", "Set-Cookie": "PHPSESSID=1"}, ct="text/html"),
        row(3, url="https://a.example/y", resp={"X-Powered-By": "PHP/8"}, ct="application/json", body="{}"),
        row(4, url="https://b.example/", ct="application/json", body="{}"),
        row(5, url="https://c.example/", status=None, body=None),
    )
    monkeypatch.setattr(queries, "inv", lambda *_, i=Inventory(ex): i)
    monkeypatch.setattr(sinks, "json_rows", lambda sections, f=sinks.json_rows: kept.append(f(sections)) or kept[0])
    kept = []
    counted = {r["section"]: (r["rows"], r["filled"]) for r in QUERIES["merged_report"](spark, SF).collect()}
    got = {j["host"]: j for j in map(json.loads, (r["json"] for r in kept[0].where("section = 'technologies'").collect()))}
    assert counted["technologies"] == (2, 2) and set(got) == {"a.example", "b.example"}
    assert got["a.example"]["technologies"] == ["Apache httpd", "PHP", "jQuery 3.6.0", "nginx"]
    assert got["a.example"]["missing_headers"] == sorted(h for h in packs.SECURITY_HEADERS if h != "X-Frame-Options")
    assert got["b.example"]["technologies"] == [] and got["b.example"]["missing_headers"] == []


def test_findings_and_tokens_are_read_in_one_pass(spark, monkeypatch):
    """The capture is read once for both, and token issues come from what was written."""
    from sightline.operators import jwt
    from sightline.plans import inventory

    plans = {}

    def written(df, name, f=inventory.persist_table):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return f(df, name)

    monkeypatch.setattr(inventory, "persist_table", written)
    i = Inventory(adapters.capture(spark, SF, "events", "pages"))
    apart = i.plain_events.unionByName(jwt.weaknesses(jwt.tokens(i.prepared)))
    assert rows(i.events.select(*apart.columns)) == rows(apart) and i.events.dtypes == apart.dtypes
    assert i.events.where("type LIKE 'JWT weakness:%'").count() > 0
    assert plans["seen-findings"].count("/events.parquet") == 1 and "/events.parquet" not in plans["seen-token-issues"]
