"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Method. A document is the set of its distinct word shingles. In round ``i`` every
shingle is placed by a hash in one bin with a value in ``[i, i + 1)``; a bin keeps
its smallest value. The first ``BINS`` rounds choose the bin at random, the next ones
are sent to bin ``i - BINS``, so every bin is filled after ``2 * BINS`` rounds at the
latest, and rounds end when all are. Bands of bins make buckets. Each bucket sends a
*star* of candidates (member, smallest member), never all its pairs; stars are
verified on the full sets. Where a bucket still holds several components afterwards,
its members outside the largest one meet the rest in blocks, and every pair that the
sketches hold possible is verified on the full sets unless it is connected already.

Defined results: null text and text without words: no shingle, linked with nothing.
Fewer words than the width: the whole sequence is the one shingle. Equal sets are one
node (copies are never expanded). Rows that repeat a ``doc_id`` count as one node.
Null ``doc_id``: the row keeps it, gets the component of its set and is not kept
unless nothing else is in it. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_batches, components, node_id, shared, table
from sightline.llm.shingles import mix, shingle_set

BINS, BAND = 128, 4
BANDS = BINS // BAND
#: Estimates below this can't belong to a similarity of 0.75 (four standard deviations).
POSSIBLE = 0.6
#: Texts of a star, or of one side of a bucket, that one task holds at a time.
BLOCK = 512
#: Hubs tried first for what stands outside the largest component of a bucket, where that has at least WIDE members in it.
BRIDGES, WIDE = 4, 32
#: Bits of the table that is sent to the readers of texts.
BITS = 1 << 24

_SALT = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketch(items: np.ndarray) -> np.ndarray:
    """``BINS`` values of the sketch; ``items`` are distinct fingerprints, at least one."""
    out = np.zeros(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    for i in range(2 * BINS):
        h = mix(items ^ _SALT[i])
        if i < BINS:
            key = np.sort(h)  # the upper bits are the bin, so the first of each bin is its minimum
            bins = (key >> np.uint64(57)).astype(np.int64)
            first = np.flatnonzero(np.diff(bins, prepend=-1))
            take = first[empty[bins[first]]]
            out[bins[take]] = mix(key[take] + np.uint64(i))
            empty[bins[take]] = False
        elif empty[i - BINS]:
            out[i - BINS] = mix(h.min() + np.uint64(i))
            empty[i - BINS] = False
        if not empty.any():
            break
    return out


def _band_keys(values: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BAND):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + values.reshape(BANDS, BAND)[:, k])
    return acc.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys, bands, short = [], [], [], []
        for text in batch.column("text").to_pylist():
            items = shingle_set(text)
            counts.append(len(items))
            if not len(items):
                keys.append(None), bands.append(None), short.append(None)
                continue
            values = sketch(items)
            with np.errstate(over="ignore"):
                both = np.array([np.bitwise_xor.reduce(mix(items)), np.add.reduce(mix(items + np.uint64(77)))], np.uint64)
            keys.append(both.tobytes()), bands.append(_band_keys(values)), short.append(values.astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
            ["doc_id", "node", "n_shingles", "set_key", "bands", "sketch"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles, set_key (128 bits of the whole set), bands, sketch; one row per row."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_id(F.col("doc_id"), F.col("text")).alias("node"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_signatures, "doc_id long, node long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _check_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (hub, block), the hub's own text first; only the hub's set is held."""
    at, hub = None, None
    for batch in batches:
        a, b = [], []
        for key, block, own, node, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "block", "member", "node", "text")), strict=True):
            if own == 0:
                at, hub = (key, block), shingle_set(text)
            elif at == (key, block) and _alike(hub, shingle_set(text)):
                a.append(node), b.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (node, hub) whose full sets reach the similarity, as links a, b.

    ``texts``: one row per node (node, text). A hub with many members is split in
    blocks; its text goes once to each.
    """
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(1 << 30)))
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    dealt = pairs.join(sizes, "hub").select("hub", (F.col("block") % F.col("blocks")).alias("block"), "node")
    heads = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"))
    both = dealt.withColumn("member", F.lit(1)).unionByName(heads.withColumn("member", F.lit(0)))
    rows = both.join(texts.select("node", "text"), "node").select("hub", "block", "member", "node", "text")
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    return rows.repartition(parts, "hub", "block").sortWithinPartitions("hub", "block", "member").mapInArrow(_check_stars, "a long, b long")


def _bridges(own: DataFrame, seed: int) -> DataFrame:
    """For members outside the largest component of a wide bucket: a few members of that component,
    chosen by hashes, as hubs to try first. A short cut only: what it misses, ``_missing_links`` finds."""
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(seed + k)).alias("h"), "node")).alias(f"p{k}") for k in range(BRIDGES)]
    tally = own.groupBy("band", "comp").agg(F.count("*").alias("n"), *picks)
    main = tally.groupBy("band").agg(F.max(F.struct("n", "comp", *[f"p{k}" for k in range(BRIDGES)])).alias("m"), F.count("*").alias("comps")).where((F.col("comps") > 1) & (F.col("m.n") >= WIDE))
    found = own.join(main, "band").where(F.col("comp") != F.col("m.comp"))
    return found.select("node", F.explode(F.array(*[F.col(f"m.p{k}.node") for k in range(BRIDGES)])).alias("hub")).distinct()


def _check_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (band, block, side): the minor members of a block are held, all others
    of the bucket's block pass by. A pair is tested in the first band that it shares, and only
    while nothing found here connects its components."""
    at, left, sketches = None, [], None
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    for batch in batches:
        a, b = [], []
        for band, no, block, side, node, comp, values, text in zip(*(batch.column(c).to_pylist() for c in ("band", "no", "block", "side", "node", "comp", "sketch", "text")), strict=True):
            if at != (band, block):
                at, left, sketches, up = (band, block), [], None, {}
            if side == 0:
                left.append((node, comp, values, shingle_set(text)))
                continue
            if not left:
                continue
            if sketches is None:
                sketches = np.stack([np.frombuffer(x[2], np.uint16) for x in left])
            values = np.frombuffer(values, np.uint16)
            score = (sketches == values).sum(axis=1)
            bands = sketches.view(np.uint64) == values.view(np.uint64)
            close = np.flatnonzero((score >= POSSIBLE * BINS) & (bands.argmax(axis=1) == no))
            own = None
            for k in close[np.argsort(-score[close], kind="stable")]:
                other, its, _, items = left[k]
                if root(its) == root(comp):
                    continue
                own = shingle_set(text) if own is None else own
                if _alike(own, items):
                    up[root(its)] = root(comp)
                    a.append(node), b.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _missing_links(own: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components of every bucket that still holds several. The members outside
    the bucket's largest component meet all members, both cut in blocks; full sets decide."""
    tally = own.groupBy("band", "comp").agg(F.count("*").alias("n"))
    per = tally.groupBy("band").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("comps"), F.sum("n").alias("size")).where("comps > 1")
    rows = own.join(per, "band").select("band", "no", "node", "comp", (F.col("comp") != F.col("main")).alias("minor"), F.ceil(F.col("size") / BLOCK).cast("long").alias("cuts"))
    rows = shared(rows, "mh-mixed")
    place = F.pmod(F.xxhash64("node"), F.col("cuts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)
    left = rows.where("minor").select("band", "no", F.lit(0).alias("side"), "node", "comp", F.explode(F.transform(every, lambda k: place * F.col("cuts") + k)).alias("block"))
    # the other side goes only where a block of minor members is
    used = rows.where("minor").select("band", place.alias("i")).distinct()
    right = rows.withColumn("j", place).join(used, "band").select("band", "no", F.lit(1).alias("side"), "node", "comp", (F.col("i") * F.col("cuts") + F.col("j")).alias("block"))
    about = nodes.select("node", "sketch").join(texts, "node")
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    both = left.unionByName(right).join(about, "node").select("band", "no", "block", "side", "node", "comp", "sketch", "text")
    return both.repartition(parts, "band", "block").sortWithinPartitions("band", "block", "side").mapInArrow(_check_block, "a long, b long")


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` (node, text) whose node is in ``wanted``. A bit table of fixed size drops most of the
    others where they are read; where it is full the join alone decides."""
    place = F.pmod(F.xxhash64("node", F.lit(9)), F.lit(BITS))
    words = wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("bits"))
    table = np.zeros(BITS // 64, np.int64)
    for r in words.collect():  # BITS / 64 rows at most
        table[r["w"]] = r["bits"]
    table = table.view(np.uint64)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy().astype(np.uint64)
            found = table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            yield batch.filter(pa.array(found.astype(bool))).select(["node", "text"])

    near = rows.withColumn("place", place).mapInArrow(sieve, "node long, text string")
    return near.join(wanted, "node", "left_semi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    sigs = shared(signatures(docs), "mh-signatures")
    filled = sigs.where("set_key IS NOT NULL")
    nodes = shared(filled.groupBy("set_key").agg(F.min("node").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "mh-nodes")
    texts = docs.select(node_id(F.col("doc_id"), F.col("text")).alias("node"), F.col("text").cast("string").alias("text"))

    band_rows = nodes.select("node", F.posexplode("bands").alias("no", "band"))
    stars = band_rows.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = shared(band_rows.join(stars, "band"), "mh-members")
    pairs = shared(members.where("node <> hub").select("node", "hub").distinct(), "mh-pairs")
    # a node's text is that of one of its rows; copies are dropped before anything is joined to it
    wanted = pairs.select("node").union(pairs.select("hub")).distinct()
    texts = shared(_only(texts, wanted).groupBy("node").agg(F.min("text").alias("text")), "mh-texts")
    links = shared(verify(pairs, texts), "mh-links")
    labels = components(links)

    larger = members.where("n > 2").select("band", "no", "node")
    labelled = lambda: larger.join(labels, "node", "left").select("band", "no", "node", F.coalesce("label", "node").alias("comp"))
    for found in (lambda own: verify(_bridges(own, 1), texts), lambda own: _missing_links(own, nodes, texts)):
        more = shared(found(shared(labelled(), "mh-own")), "mh-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)

    # rows of one doc_id, or of one set, are one class: chain both to the component of their set
    of_set = nodes.select("set_key", "node").join(labels.withColumnRenamed("label", "comp"), "node", "left").select("set_key", F.coalesce("comp", "node").alias("comp"))
    rows = sigs.join(of_set, "set_key", "left").select("doc_id", "node", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    # written first, so that the join's sides are plain exchanges, of which a skewed one can be split
    rows = shared(rows, "mh-rows")
    least = shared(rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min("node").alias("first")), "mh-least")
    return rows.join(least, "comp").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("node") == F.col("first"))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, one document of each class; documents without words all stay,
    as do rows without a ``doc_id``, which nothing tells apart. Of rows that repeat a
    ``doc_id`` one stays."""
    classes = near_duplicates(docs).select("doc_id", "kept")
    out = docs.join(classes.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    repeated = shared(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "mh-repeated")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return out.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB: every pair of documents that shares a shingle, then what can be reached over the links.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY 1) m ON m.doc_id = s.doc_id
"""
