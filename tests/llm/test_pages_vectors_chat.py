"""Operators on pages, vectors and conversations against brute force, and on odd rows."""

import hashlib
import math
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import chat, extraction, vectors, warc
from sightline.llm.common import components
from sightline.llm.queries import SQL

PAGES = "page_id long, url string, html string"


# ------------------------------------------------------------------ archives


def test_archives_read_back(spark, tmp_path):
    r = random.Random(1)
    long = ["<p>" + "ä" * 60 + f"{k}</p>\r\n\r\nWARC/1.1" for k in range(5)]
    rows = [(k, f"http://{r.choice(['www.b.example', 'a.example:8080', 'B.example'])}/{k % 7}?q={k % 3}#f", r.choice(long)) for k in range(200)]
    rows += [(900, None, None), (901, "", ""), (902, "::bad[", "short"), (903, "http://x/ ü\n", "short"), (2**40, "http://x/", long[0])]
    spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).write.parquet(str(tmp_path / "pages.parquet"))
    out = {x["page_id"]: x for x in warc.op2_warc(spark, str(tmp_path)).collect()}
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html, i)
    assert set(out) == {i for i, *_ in rows}
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first[html] != i
        x = out[i]
        assert (x["payload_bytes"], x["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (x["record_type"], x["refers_to"]) == (("revisit", first[html]) if again else ("response", None))


def test_lookup_finds_every_capture_of_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(k, f"http://h{k % 5}.example/p", f"x{k}") for k in range(60)] + [(100 + k, "http://hot.example/", f"y{k}") for k in range(90)]
    folder = str(tmp_path / "w")
    captures = warc.write_archives(spark.createDataFrame(rows, PAGES), f"{folder}/a")
    index = warc.build_index(captures, f"{folder}/i")
    assert index.directory.agg(F.sum("lines")).first()[0] == 150
    asked = spark.createDataFrame([(warc.url_key(u),) for u in ("http://hot.example/", "http://h3.example/p", "http://none.example/", "http://zz/")] + [(None,)], "key string")
    found = warc.read_records(warc.lookup(index, asked), f"{folder}/a", payloads=True).collect()
    assert sorted((x["page_id"], bytes(x["payload"]).decode()) for x in found) == sorted((i, t) for i, u, t in rows if "hot" in u or "h3" in u)
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0
    twice = warc.archived(spark.createDataFrame([(None, "u", "z" * 200), (3, "u", "z" * 200), (3, "u", "z" * 200), (4, "v", "z" * 200)], PAGES)).collect()
    assert sorted((x["page_id"] or 0, x["record_type"]) for x in twice) == [(0, "response"), (3, "response"), (3, "response"), (4, "revisit")]


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.com:80/A?b#c") == "com,example,www)/A?b"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/"
    assert warc.url_key("") == "" and warc.url_key("::bad[") == "::bad["


# ------------------------------------------------------------------ main text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain < 3 &lt; text", "plain < 3 < text"),
        ("<div>a<p>b<br>c</div>x <unclosed \"", "a\nb c\nx"),
        ("<article><header><h1>T &amp; U</h1></header><p>a <b>b</b>\n c&nbsp;d<p>e<ul><li>one<li>two</ul></article>", "T & U\na b c d\ne\none\ntwo"),
        ("<body class='has-sidebar'><header>Site</header><nav>n</nav><article><p>k<aside>z</aside><form>f</form><p class=notice>w</article><footer>f</footer>", "k"),
        ("<article><p>t</p><section class='comments'><p>hi</p></section></article><div id=comments><article class=comment>c</article></div>", "t"),
        ("<main><p>m</p></main><div>o</div>", "m"),
        ("<script>var a='</p><p>x';</script><style>p{}</style><p>y</p><!-- z --><textarea>q</textarea>", "y"),
        ("<div class='cookie-banner'>c</div><div role=dialog>d</div><div hidden>h</div><div style='display: none'>i</div>k", "k"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<a title='x>y'>k</a> <![CDATA[l]]><p>&#x41;&eacute;&notareal;</p>", "k l\nAé¬areal;"),
        ("<p>cut <b", "cut"),
    ],
)
def test_blocks_of_a_page(html, text):
    assert extraction.Page(html).kept() == text


TEXT = "This is the main text of the page, long enough to be it."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><div class='page has-sidebar'><nav>x</nav><article><p>{TEXT}</p></article><div class='sidebar'>links</div></div></body>", TEXT),
        (f"<div class='no-sidebar'><p>{TEXT}</p></div>", TEXT),
        (f"<div class='content-widget'><p>{TEXT}</p></div><div class='widget'>more</div>", TEXT),
        (f"<article><p>{TEXT}</p><section id='discussion'><h2>Discussion</h2><p>We discuss.</p></section><div class='comments'>bah</div></article>", f"{TEXT}\nDiscussion\nWe discuss."),
        (f"<main><p>{TEXT}</p></main><article>teaser</article>", TEXT),
        (f"<div><p>{TEXT}</p><p>{TEXT}</p></div><article>teaser one</article><article>teaser two</article>", f"{TEXT}\n{TEXT}"),
        (f"<div class=post><p>{TEXT}</p></div><div id=comments>" + "<article>c c c c</article>" * 9 + "</div>", TEXT),
        (f"<article><p>{TEXT}</p></article><ol class=commentlist>" + "<li><article>bla bla</article></li>" * 50 + "</ol>", TEXT),
        (f"<div class='page no-sidebar'><div class='menu-open'><p>{TEXT}</p></div><div class='share'>share</div></div>", TEXT),
    ],
)
def test_names_are_evidence_only(html, text):
    assert extraction.Page(html).kept() == text


def test_unclosed_inline_elements_are_linear():
    def seconds(n):
        start = time.process_time()
        extraction.Page("<i>" * n + "x</b>y").kept()
        return time.process_time() - start

    seconds(1000)
    assert seconds(80_000) < 30 * max(seconds(8_000), 0.02)


def test_hostile_markup_is_linear():
    for html in ("<div>" * 30000 + "x", '<a b="' * 30000, "<" * 200000, "<p>" * 60000, "<!--" * 50000, "</div>" * 50000, "<div class='a b'><p>t" * 4000):
        extraction.Page(html).kept()


@pytest.mark.parametrize("small", [10**6, -1])
def test_site_trees_remove_what_every_page_repeats(spark, monkeypatch, small):
    monkeypatch.setattr(extraction, "SMALL", small)
    rows = [(k, f"http://H.example:80/{k}", f"<body><div class=z>Same line here<p>again</p></div><div class=c><p>own text {k} with more words than the rest</p></div></body>") for k in range(30)]
    rows += [(100 + k, f"http://lone{k}.example/", rows[0][2]) for k in range(3)] + [(200, None, None), (200, None, ""), (None, "http://h.example/", rows[1][2])]
    out = extraction.main_texts(spark.createDataFrame(rows, PAGES).withColumn("path", F.lit(1)).withColumn("host", F.lit(2))).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] is not None and r["page_id"] < 100:
            assert r["text"] == f"own text {r['page_id']} with more words than the rest"
        elif r["page_id"] is not None and r["page_id"] < 200:
            assert r["text"].startswith("Same line here\nagain\nown")
    assert [r["text"] for r in out if r["page_id"] == 200] == ["", ""]
    assert extraction.main_texts(spark.createDataFrame([], PAGES)).count() == 0


# ------------------------------------------------------------------ vectors


def test_vector_links_match_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(int(k), v.tolist()) for k, v in enumerate(r.normal(size=(700, 24)))]
    rows += [(1000 + k, (np.array(rows[k % 9][1]) + 0.08 * r.normal(size=24)).tolist()) for k in range(60)]
    rows += [(2000 + k, rows[4][1]) for k in range(50)] + [(3000, [3 * x for x in rows[5][1]])]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [None] + [1.0] * 23), (5004, [math.nan] + [1.0] * 23), (5005, [math.inf] + [1.0] * 23), (5006, [1.0] * 7), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("label", F.lit(2))
    out = vectors.near_vectors(df).collect()
    got = {x["vec_id"]: x for x in out}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids = [i for i, _ in rows]
    label = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min(label[j] for j in np.flatnonzero(near[k])) for k in range(len(ids))]
        if new == label:
            break
        label = new
    n = near.sum(axis=1) - 1
    right = sum(got[i]["n_links"] == n[k] and got[i]["component_id"] == ids[label[k]] for k, i in enumerate(ids))
    assert right >= 0.99 * len(ids) and all(got[i]["n_links"] <= n[k] for k, i in enumerate(ids))
    for i, _ in odd[:-1]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(out) == len(rows) + len(odd)
    assert all(y["kept"] == (y["vec_id"] == y["component_id"]) for y in out if y["vec_id"] is not None)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_low_rank_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 64)
    r = np.random.default_rng(11)
    plane = np.linalg.qr(r.normal(size=(256, 10)))[0]
    one = r.normal(size=(1500, 10))
    step = r.normal(size=(1500, 10))
    one, step = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (one, step))
    x = np.concatenate([one, one + r.uniform(0.1, 0.45, size=(1500, 1)) * step]) @ plane.T
    out = vectors.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    assert {y["vec_id"]: y["n_links"] for y in out} == dict(enumerate((near.sum(axis=1) - 1).tolist()))
    label = np.arange(len(x))
    while ((new := np.where(near, label, len(x)).min(axis=1)) != label).any():
        label = new
    assert {y["vec_id"]: y["component_id"] for y in out} == dict(enumerate(label.tolist()))


def test_hot_lists_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = np.random.default_rng(5)
    one = r.normal(size=12)
    rows = [(k, (one + 0.05 * r.normal(size=12)).tolist()) for k in range(100)]
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(x["n_links"], x["component_id"]) for x in out} == {(99, 0)}


def test_vectors_are_not_shuffled_to_what_they_probe(spark, monkeypatch):
    """Every vector is in one block, and blocks meet without an exchange, however many groups a vector probes."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 8)
    monkeypatch.setattr(vectors, "GROUP_LISTS", 2)
    kept = {}
    monkeypatch.setattr(vectors, "shared", lambda df, name, f=vectors.shared: kept.setdefault(name, (df, f(df, name)))[1])
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, x[:90] + 0.05 * r.normal(size=(90, 24)), 2 * x[:40]]))]
    out = {y["vec_id"]: y for y in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    blocks = kept["pq-blocks"][1].collect()
    assert sum(len(b["entry"]) // 8 for b in blocks) == 690 and len({b["group"] for b in blocks}) > 10
    assert max(len(b["asks"]) for b in blocks) > 10
    assert {len(b["vector"]) // (len(b["entry"]) // 8) for b in blocks} == {24 * 4}
    plan = kept["pq-links"][0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    y = np.array([v for _, v in rows], np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert {i: o["n_links"] for i, o in out.items()} == dict(enumerate(((y @ y.T >= 0.9).sum(axis=1) - 1).tolist()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(50)] + [(2000, 2000), (None, 3), (5000, 300), (300, 5000)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1050), 1000), 2000: 2000, 300: 300, 5000: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ conversations

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_reads_back_and_agrees_with_sql(spark, tmp_path):
    r = random.Random(2)
    bits = ["<|end|>\n", "<|turn|>", "\\", "<", "|", "[INST]", "[/INST]", "</s>", "<s>", "é😀", " ", "\n", "<<SYS>>", "a", "<\\|", "$1", "<start_of_turn>"]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randrange(12)))
    rows = [(k // 6, k % 6, r.choice(["user", "assistant", "system", "a<|body|>b", None]), text() if k % 11 else None) for k in range(240)]
    rows += [(500, 1, "user", "tie"), (500, 1, "assistant", "tie"), (500, 1, "assistant", "tie"), (501, None, "assistant", "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1)).withColumn("nr", F.lit(1))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = chat.op10_chat_formatting(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    rel = con.sql(SQL["op10_chat_formatting"])
    names = rel.columns
    want = {tuple(dict(zip(names, x, strict=True))[c] for c in out[0].asDict()) for x in rel.fetchall() if x[0] != 501}
    got = {tuple(x) for x in out if x["conv_id"] != 501}
    assert got == want
    by = {}
    for c, t, role, s in sorted(rows, key=lambda x: (x[0] or -9, x[1] or -9, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", s or ""))
    for x in out:
        if x["conv_id"] != -1:
            said = "".join(f"{a}\n{b}\n" for a, b in by[x["conv_id"]])
            assert x["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and x["n_turns"] == len(by[x["conv_id"]])


def test_parts_become_placeholders(spark):
    parts = [("text", "hi <|", None, None), ("image", None, "s3://x.png", 64), ("audio", None, "b", None), None, ("other", None, None, None), ("text", None, None, None)]
    rows = [(5, 0, "user", parts), (5, 1, "assistant", [("text", "ok", None, None)]), (6, 0, "user", None), (7, 0, "assistant", [])]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")).collect()}
    text = out[5]["formatted"]
    assert text == "<|turn|>user<|body|>hi <\\|<|image|><|audio|><|document|><|end|>\n<|turn|>assistant<|body|>ok<|end|>\n"
    assert [(a["type"], a["ref"], a["tokens"], text[a["at"] : a["at"] + 3]) for a in out[5]["attachments"]] == [("image", "s3://x.png", 64, "<|i"), ("audio", "b", 250, "<|a"), ("document", None, 1024, "<|d")]
    assert [text[s["start"] : s["end"]] for s in out[5]["loss_spans"]] == ["ok"]
    assert out[6]["formatted"] == "<|turn|>user<|body|><|end|>\n" and out[7]["loss_spans"][0]["start"] == out[7]["loss_spans"][0]["end"]
