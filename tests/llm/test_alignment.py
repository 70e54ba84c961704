"""Cross-tokenizer alignment against whole encodings and counts in plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sightline.llm import alignment

SCHEMA = "doc_id long, text string"
TEXTS = [
    "The quick brown fox jumps over the lazy dog. The dog doesn't mind.", "the the the the", "Straße für Öl\nzweite Zeile  mit   Raum \n Ende ", "a", " a", "a  b ", "a\n b\n  c", "  ", "   x   ", " \n", "\n ", "a \xa0 b",
    "<s>x</s> <unk> <|endoftext|> <0x41>", "x　y \x1c z", "a\tb   c\x85 d", "it's we'll  don't 's", "héllo 日本語 😀 " * 5, "x" * 3000, "é ﬁ é", None, "", "a▁b", "the quick fox", "the quick fox", "0123 45,678.9 " * 40,
]


def expected(rows):
    pair = alignment.pair_of(alignment.vocabulary(alignment.BYTE_VOCABULARY), alignment.vocabulary(alignment.PIECE_VOCABULARY))
    docs = []
    for text in rows:
        raw = " " + (text or "")
        a = pair.a.encode(raw, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        a_bytes, b_bytes = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
        if not text or b"".join(a_bytes) != raw.encode() or b"".join(b_bytes) != raw.encode():
            docs.append(None)
            continue
        ends = lambda parts: [len(b"".join(parts[: k + 1])) for k in range(len(parts))]
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        both = sorted(set(a_ends) & set(b_ends))
        links = [(x, y) for x, e in zip(a, a_ends, strict=True) for y, f in zip(b, b_ends, strict=True) if e == f]
        groups = []
        for low, high in zip([0, *both], both, strict=False):
            side = lambda ids, e: ",".join(str(i) for i, k in zip(ids, e, strict=True) if low < k <= high)  # noqa: B023, E731
            groups.append(f"{side(a, a_ends)}|{side(b, b_ends)}")
        docs.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(k for d in docs if d for k in d[3])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(counts[k] == top[k[1]] for k in d[3])
            out.append((*d[:3], len(d[3]), best, sum(counts[k] for k in d[3]), hashlib.sha256(d[4].encode()).hexdigest()))
    return out, counts, top


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_matches_whole_encodings(spark, monkeypatch, small):
    if small:  # many runs, several levels of merging, chunks of a few pairs, several blocks
        for name, value in {"RUN_LINKS": 40, "RUN_DOCS": 2, "RADIX": 4, "FAN": 2, "CHUNK": 3, "BLOCK_RUNS": 2}.items():
            monkeypatch.setattr(alignment, name, value)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA).withColumn("run", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs).collect()}
    want, _, _ = expected(TEXTS)
    assert [got[k] for k in range(len(TEXTS))] == want


def test_pair_table_and_groups(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    rows = alignment.pair_table(alignment.count_pairs(alignment.spill(docs))).collect()
    _, counts, top = expected(TEXTS)
    assert {(r["a_id"], r["b_id"]): r["count"] for r in rows} == counts
    assert all(r["best"] == (r["count"] == top[r["b_id"]]) for r in rows)
    got = {r["doc_id"]: r for r in alignment.align(docs, keep_groups=True).collect()}
    for k, t in enumerate(TEXTS):
        r = got[k]
        assert (r["groups"] is None) == (r["groups_sha256"] == "") == (r["n_a"] == 0), t
        assert r["groups"] is None or hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"]


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "the dog"), (1, "the dog"), (None, "the dog"), (None, None)]
    got = alignment.align(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] is None, r["n_links"], r["count_sum"]) for r in got) == [(False, 2, 6), (False, 2, 6), (True, 0, 0), (True, 2, 6)]
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(alignment.align(spark.createDataFrame([(5, None)], SCHEMA)).collect()) == 1


def test_a_very_long_text_is_one_document(spark):
    text = "word another thing " * 60_000
    got = alignment.align(spark.createDataFrame([(1, text), (2, "x")], SCHEMA)).where("doc_id = 1").collect()[0]
    two, three = (expected(["word another thing " * k])[0][0] for k in (2, 3))
    assert all(got[c] == three[i] + (60_000 - 3) * (three[i] - two[i]) for i, c in enumerate(COLUMNS[:4]))
