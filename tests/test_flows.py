"""Client flows against captured endpoints."""

import random
import re

from sightline.operators import flows

PATHS = [
    "/", "/api", "/api/{id}", "/api/{id}/items", "/api/{a}/{b}", "/{x}/{y}/{z}", "/api/item-{id}.json", "/api/item-{id}-{no}.json", "/api/{n}.json", "/files/v{major}.{minor}/get",
    "https://h.example/api/{id}?q={q}", "/api/a.b", "/api/a+b", "/api/{id}/", "/{only}", "/api/(x)/{id}", "/api/i{k}", "/api/it{k}", "/deep" + "/{s}" * 20, "/api/{open",
]
ROUTES = [
    "/", "/api", "/api/7", "/api/7/items", "/api/7/8", "/x/y/z", "/api/item-5.json", "/api/item-5-6.json", "/api/item-.json", "/api/.json", "/files/v1.2/get", "/files/v1/get",
    "/api/a.b", "/api/aXb", "/api/a+b", "/api/aab", "/api/(x)/1", "/api//items", "/deep" + "/s" * 20, "/deep" + "/s" * 19, "/api/item", "/api/{open", "/zz",
]


def expected(path, method, eps):
    plain = re.sub(r"^https?://[^/]*", "", path)
    plain = plain if plain == "/" else plain.rstrip("/")
    pattern = "".join("[^/]+" if re.fullmatch(r"\{[^}/]*\}", p) else re.escape(p) for p in re.split(r"(\{[^}/]*\})", plain))
    return any(m == method and s != 0 and re.fullmatch(pattern, r if r == "/" else r.rstrip("/")) for m, r, s in eps)


def seen(spark, paths, eps):
    f = spark.createDataFrame([(m, p, k) for k, (m, p) in enumerate(paths)], "method string, path string, k int")
    e = spark.createDataFrame(eps, "method string, path string, last_status int")
    return {(r["method"], r["path"]): r["seen"] for r in flows.flow_seen(f, e).collect()}


def test_trie_matches_brute_force(spark):
    rng = random.Random(3)
    every = [(m, p) for p in PATHS for m in ("GET", "POST")]
    for _ in range(2):
        eps = [(rng.choice(["GET", "POST"]), r, rng.choice([0, 200, 404])) for r in rng.sample(ROUTES, 14)]
        got = seen(spark, every, eps)
        assert got == {(m, p): expected(p, m, eps) for m, p in every}
    eps = [("GET", r, 200) for r in ROUTES]
    got = seen(spark, every, eps)
    assert got == {(m, p): expected(p, m, eps) for m, p in every} and sum(got.values()) >= 15


def test_no_flows_or_no_endpoints(spark):
    assert seen(spark, [("GET", "/a")], [("GET", "/a", 0)]) == {("GET", "/a"): False}
    assert seen(spark, [], [("GET", "/a", 200)]) == {}


def test_joins_name_the_node(spark):
    """No join key is a placeholder alone: every edge is looked up under the node above it."""
    f = spark.createDataFrame([("GET", p) for p in PATHS], "method string, path string")
    edges = flows.trie(f).collect()
    assert len({(r["verb"], r["parent"], r["edge"]) for r in edges}) == len(edges)
    assert all(sum(x["edge"] == "{}" for x in edges if x["parent"] == r["parent"]) <= 1 for r in edges)
