from pyspark.sql import functions as F

from sightline.functions import checks, classify, text, urls
from sightline.operators import diff, filters, replay, sessions


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_value_kind(spark):
    vals = ["https%3A%2F%2Fh.example%2Fx", "//h.example/x", "/home/mypage", "rO0AB", "a:2:{x}", "hello", " ", "884213", "12", "u@h.example"]
    assert apply(spark, vals, classify.value_kind) == ["url", "url", "path", "serialized", "serialized", "", "", "numeric-id", "number", "email"]


def test_route_path(spark):
    vals = ["https://h.example/admin/users/?x=1#top", "api/v1/export", "//cdn.example/x", "https://h.example", "./a", "/", "//"]
    assert apply(spark, vals, urls.route_path) == ["/admin/users", "/api/v1/export", "/x", "/", "/a", "/", "/"]


def test_categories_and_hints(spark):
    vals = ["Client Flow: IDOR candidate", "Client Flow", "AWS Access Key ID", "Java Stack Trace", "CORS wildcard", "HTML Comment", "odd"]
    assert apply(spark, vals, classify.category) == ["Auth", "API", "Secret", "Info leak", "Misconfig", "Comment", "Other"]
    assert apply(spark, ["a  |  Try: do it", "none"], classify.own_hint) == ["do it", ""]


def test_mask_never_shows_the_middle(spark):
    vals = ["a", "12345678", "123456789", "abcdefghijklmnop"]
    assert apply(spark, vals, text.mask) == ["a***", "1***", "1234…6789", "abcd…mnop"]


def test_checksums(spark):
    assert apply(spark, ["4111111111111111", "4111111111111112", "0000000000000000", "378282246310005"], checks.plausible_card) == [True, False, False, True]


def test_cookies_and_tokens(spark):
    got = apply(spark, ["a=1; b; a=2; =x"], lambda c: F.to_json(checks.cookie_pairs(c)))
    assert got == ['[{"name":"a","value":"2"},{"name":"b","value":""},{"name":"=x","value":""}]']
    df = spark.createDataFrame([([("Cookie", "_ga=GA1; JSESSIONID=ABC; theme=dark"), ("Authorization", "Bearer abc"), ("X-Auth-Token", "t"), ("If-None-Match", "c0ffee11d4b27a93c0ffee11d4b27a93")],)], "h array<struct<name:string,value:string>>")
    parts = df.select(checks.auth_parts(F.col("h")).alias("p")).first()["p"]
    assert [p["name"] for p in parts] == ["JSESSIONID", "Authorization", "X-Auth-Token"]
    strip = df.select(sessions.strip_auth(F.col("h"), sessions.RewriteRule("STRIP_AUTH", keep_headers=("authorization",))).alias("h")).first()["h"]
    assert [tuple(h)[0] for h in strip] == ["Cookie", "Authorization", "If-None-Match"] and strip[0]["value"] == "_ga=GA1; theme=dark"


def test_search_and_values(spark):
    df = spark.createDataFrame([("Foo bar",), ("foo baz",), ("-x",), (None,)], "s string")
    hits = lambda q, **k: [r[0] for r in filters.search(df, F.col("s"), q, **k).collect()]
    assert hits("FOO -baz") == ["Foo bar"] and hits("-") == ["-x"] and hits("foo(", regex=True) == [] and hits("Foo", case_sensitive=True) == ["Foo bar"]
    assert [r[0] for r in filters.value_filter(df, "s", ["-x"]).collect()] == ["Foo bar", "foo baz", None]


def test_scope(spark):
    df = spark.createDataFrame([("https://a.example/x",), ("https://b.example/x",)], "url string")
    n = lambda inc, exc: filters.scope(df, inc, exc).count()
    assert (n("", ""), n("a\\.", ""), n("a\\.", "x"), n("(", ""), n("", "(")) == (2, 1, 0, 2, 2)


def test_replay_verdicts(spark):
    a = '{"at":1700000000000,"k":"0123456789abcdef0123456789abcdef","v":1}'
    b = '{"at":1700000000999,"k":"ffffffffffffffffffffffffffffffff","v":1}'
    rows = [("1", 200, a, None, 200, b), ("2", 403, "", None, 200, a), ("3", 302, "", "/portal/login.aspx", 200, a), ("4", 302, "", "/home", 200, a), ("5", 200, "other", None, 200, a), ("6", None, None, None, 200, a)]
    df = spark.createDataFrame(rows, "target_key string, status int, body string, location string, orig_status int, orig_body string")
    df = df.selectExpr("*", "cast(null as string) error", "0 length", "0 orig_length")
    got = {r["target_key"]: r["verdict"] for r in replay.compare(df).collect()}
    assert got == {"1": "SAME", "2": "BLOCKED", "3": "BLOCKED", "4": "DIFFERENT", "5": "DIFFERENT", "6": "NA"}


def test_keyed_diff(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), (None, 3, "x")], "k string, seq int, v string")
    new = spark.createDataFrame([("b", 1, "y"), ("c", 2, "x"), ("b", 3, "z"), (None, 4, "q")], "k string, seq int, v string")
    got = sorted((r["key"], r["change"]) for r in diff.three_way(old, new, F.col("k"), F.col("v"), "seq").collect())
    assert got == [("a", "-"), ("b", "~"), ("c", "+")]
    assert diff.three_way(old, old, F.col("k"), F.col("v"), "seq").count() == 0


def test_session_discovery(spark, exchanges):
    from conftest import row

    ex = exchanges(
        row(1, url="https://app.example/a", req={"Authorization": "Bearer abc", "X-CSRF-Token": "1"}), row(2, url="https://app.example/b", req={"Authorization": "Bearer abc", "X-CSRF-Token": "2"}),
        row(3, url="https://app.example/c", req={"Cookie": "JSESSIONID=BOB; _ga=1"}), row(4, url="https://app.example/d", req={"Accept": "*/*"}),
    )
    got = sessions.discover(ex.withColumn("observed_at", F.timestamp_seconds("seq")), [sessions.Identity("bob", {}, {"JSESSIONID": "BOB"})]).collect()
    assert [(r["requests"], r["sample_path"], r["registered_as"]) for r in sorted(got, key=lambda r: r["sample_path"])] == [(2, "/b", ""), (1, "/c", "bob")]
    alice = next(r for r in got if r["requests"] == 2)
    assert {p["name"]: p["value"] for p in alice["parts"]}["X-CSRF-Token"] == "2"


def test_newest_keeps_exactly_n(spark):
    df = spark.range(5000).select(F.col("id").alias("first_seq"))
    got = filters.keep_newest(df, 1234, "first_seq").agg(F.count("*").alias("n"), F.min("first_seq").alias("m")).first()
    assert (got["n"], got["m"]) == (1234, 5000 - 1234)


def test_bodies_that_do_not_inflate_say_so(spark):
    import gzip

    from sightline.sources import readers

    rows = [(1, gzip.compress(b"ok"), "gzip"), (2, b"plain", "gzip"), (3, b"\x1f\x8bxx", "gzip"), (4, b"abc", "br"), (5, None, "deflate"), (6, b"x", "")]
    df = spark.createDataFrame([(i, b, e, "text/plain; charset=utf-8") for i, b, e in rows], "id int, raw_body binary, content_encoding string, content_type string")
    got = {r["id"]: (r["text"], r["body_error"]) for r in readers.normalise_bodies(df).collect()}
    assert got[1] == ("ok", None) and got[2] == ("plain", None) and got[6] == ("x", None)
    assert got[3][1].startswith("gzip: ") and got[4][1].startswith("br: ") and got[4][0] in (None, "abc")
