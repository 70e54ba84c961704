"""Links between vectors by product quantisation over inverted lists.

Method. Unit vectors are assigned to coarse centroids; what a centroid leaves over (the
residual) is coded per subspace by its nearest codeword. A query probes the lists that
can hold a vector as near as asked, scores the codes there by table lookups (asymmetric
distances: the query is not coded), and the candidates are reranked by exact cosine in
double precision. Each code carries the length of its own error, so the lookup score
plus that length bounds the cosine from above: the filter loses nothing in a probed list.

Probes. A vector at the asked cosine lies on a cap around the query. A list is probed
when the cap reaches over the plane between that list's centroid and the query's own
(Cauchy-Schwarz), so nothing is assumed of how vectors are spread and no link is lost.
Lists that lie together are one group.

Centroids and codewords are fitted on at most ``FIT_ROWS`` vectors, chosen by a hash;
every vector is indexed and every vector is a query. Equal vectors are one entry with a
count, so copies are never compared or expanded. A group is cut in blocks of entries, each
one row of a table that is written once. Every two blocks of which one probes the group of
the other meet in a Cartesian product, which reads the table again and shuffles nothing, so
disk grows with the vectors and not with their probes. What is near one way is near the
other, so two blocks meet once; a meeting emits, next to counts, only a spanning forest of
the links it finds.

Defined results: vectors that are null, empty, of zero length, or hold null, infinite or
NaN components, and those of another dimension than the most frequent one, link with
nothing but are returned. Rows that repeat a vec_id are one vector id with the links of
all its rows; a null vec_id is returned without links. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_batches, components, shared, table

LEAST_COSINE = 0.9
FIT_ROWS, LIST_ROWS, MOST_LISTS = 50_000, 256, 4096
#: Subspaces of a residual, codewords in each, rounds of k-means.
SUBSPACES, CODEWORDS, ROUNDS = 8, 64, 8
#: Lists in a group, on average.
GROUP_LISTS = 16
#: Entries of a group, and queries against it, that one task compares at a time, and the bytes of their vectors.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Room for rounding where lists and lookups are in single precision.
ROUNDING = 1e-5


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centers)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = 0.5 * (centers * centers).sum(axis=1)
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = np.argmax(x[k : k + 4096] @ centers.T - half, axis=1)
    return out


@dataclass
class Quantiser:
    """Coarse centroids, the group of each and, per subspace, codewords of residuals."""

    centers: np.ndarray
    groups: np.ndarray
    words: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int) -> Quantiser:
        lists = max(1, min(MOST_LISTS, rows // LIST_ROWS, len(sample) // 8))
        centers = _kmeans(sample, lists, 1)
        left = sample - centers[_nearest(sample, centers)]
        cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        groups = _nearest(centers, _kmeans(centers, -(-lists // GROUP_LISTS), 1))
        return cls(centers.astype(np.float32), groups, [_kmeans(left[:, c], CODEWORDS, 2 + k).astype(np.float32) for k, c in enumerate(cuts)])

    @property
    def cuts(self) -> list[slice]:
        ends = np.cumsum([w.shape[1] for w in self.words])
        return [slice(e - w.shape[1], e) for e, w in zip(ends, self.words, strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the length of the coding error of every row."""
        own = _nearest(x, self.centers)
        left = x - self.centers[own]
        codes = np.stack([_nearest(left[:, c], w) for c, w in zip(self.cuts, self.words, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)
        return own, codes, np.linalg.norm(left - back, axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray]]:
        """For some rows at a time, which of the lists (all by default) can hold a vector at the asked cosine.

        With ``w`` from the row's own centroid to another, a vector at an angle ``t`` reaches
        ``cos(t) p + sin(t) q`` along ``w`` at most, where ``p`` and ``q`` are the parts of
        ``w`` along and across the row; it can be in that list if this passes the plane between.
        """
        centers = self.centers.astype(np.float64)
        others = centers if lists is None else centers[lists]
        square = (others * others).sum(axis=1)
        for k in range(0, len(x), 1024):
            part, mine = x[k : k + 1024], centers[own[k : k + 1024]]
            length = (mine * mine).sum(axis=1)[:, None]
            along = part @ others.T - (part * mine).sum(axis=1)[:, None]
            apart = np.maximum(0, length + square - 2 * (mine @ others.T))
            across = np.sqrt(np.maximum(0, apart - along * along))
            apart = np.sqrt(apart)
            most = np.where(along >= LEAST_COSINE * apart, apart, LEAST_COSINE * along + np.sqrt(1 - LEAST_COSINE**2) * across)
            yield slice(k, k + len(part)), most + ROUNDING >= 0.5 * (square - length)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Inner products of every codeword with every query, per subspace."""
        return [w @ queries[:, c].T for c, w in zip(self.cuts, self.words, strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled into range first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (as given, or doubles), d and ok: whether the vector can link at all."""
    given = dict(vectors.dtypes)["embedding"]
    kind = "array<float>" if given == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.size("embedding").alias("d"))
    clean = F.coalesce(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    return rows.withColumn("ok", clean & F.col("vec_id").isNotNull())


def _key() -> Column:
    """Digest of the scaled vector: equal vectors are equal after scaling, a double and its text stand for each other, and zero has no sign.

    The scale is bound by a lambda of its own; within the other one it would be found again for every component.
    """
    wide = F.col("embedding").cast("array<double>")
    scaled = lambda top: F.transform(wide, lambda v: F.when(v == 0, F.lit("0")).otherwise((v / top).cast("string")))
    top = F.greatest(F.array_max(wide), -F.array_min(wide))
    return F.unhex(F.sha2(F.get(F.transform(F.array(top), lambda t: F.array_join(scaled(t), ",")), F.lit(0)), 256))


def entries(vectors: DataFrame) -> DataFrame:
    """key, entry (smallest vec_id), n, embedding: the distinct usable vectors."""
    rows = usable(vectors).where("ok")
    sizes = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1)
    width = sizes.collect()  # one row
    rows = rows.where(F.col("d") == (width[0]["d"] if width else 0)).withColumn("key", _key())
    return rows.groupBy("key").agg(F.min("vec_id").alias("entry"), F.count_distinct("vec_id").alias("n"), F.any_value("embedding").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _counted(model: Quantiser):
    """Entries of each group, a row per batch and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                groups, n = np.unique(model.groups[_nearest(_unit(_matrix(batch.column("embedding"))).astype(np.float32), model.centers)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(n, pa.int64())], ["group", "n"])

    return run


def _coded(model: Quantiser):
    """Per entry its group, list, codes and the length of the coding error, with the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            own, codes, error = model.encode(_unit(x).astype(np.float32))
            rows = lambda a: pa.array([r.tobytes() for r in np.ascontiguousarray(a)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(model.groups[own], pa.int64()), pa.array(own, pa.int32()), batch.column("entry"), batch.column("n"), rows(x), rows(codes), pa.array(error, pa.float32())],
                ["group", "list", "entry", "n", "vector", "code", "error"],
            )

    return run


#: A block is one row; its columns of bytes hold these numbers of its entries, in the order of their lists.
PACKED = {"list": np.int32, "entry": np.int64, "n": np.int64, "vector": None, "code": np.uint8, "error": np.float32}
BLOCKS = "no long, group long, asks array<int>, " + ", ".join(f"{c} binary" for c in PACKED)


def _pack(model: Quantiser, width: np.dtype):
    """Rows come sorted by (group, block); every block becomes one row, with the groups that it probes."""

    def row(group: int, block: int, held: list[tuple]) -> list:
        held = sorted(held, key=lambda h: (h[0], h[1]))
        lists = np.array([h[0] for h in held], np.int32)
        x = _unit(np.frombuffer(b"".join(h[3] for h in held), width).reshape(len(held), -1))
        asked = np.zeros(len(model.centers), bool)
        for _, reach in model.probes(x, lists):
            asked |= reach.any(axis=0)
        plain = [b"".join(h[k] for h in held) if c in ("vector", "code") else np.array([h[k] for h in held], kind).tobytes() for k, (c, kind) in enumerate(PACKED.items())]
        return [group << 32 | block, group, np.unique(model.groups[asked]).tolist(), *plain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["no", "group", "asks", *PACKED]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * len(PACKED)]
        made = lambda r: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, kinds, strict=True)], names)
        at, held = None, []
        for batch in batches:
            for group, block, *rest in zip(*(batch.column(c).to_pylist() for c in ("group", "block", *PACKED)), strict=True):
                if at != (group, block):
                    if held:
                        yield made(row(*at, held))
                    at, held = (group, block), []
                held.append(tuple(rest))
        if held:
            yield made(row(*at, held))

    return run


def _cosines(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``x`` with rows of ``y``, so many at a time that the copies stay small."""
    step = max(1, (1 << 21) // x.shape[1])
    parts = [(y[cols[k : k + step]] * x[rows[k : k + step]]).sum(axis=1) for k in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.empty(0)


@dataclass
class Block:
    """The columns of a block, read back."""

    no: int
    list: np.ndarray
    entry: np.ndarray
    n: np.ndarray
    vector: np.ndarray
    code: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, no: int, packed: dict[str, bytes], width: np.dtype) -> Block:
        x = {c: np.frombuffer(b, PACKED[c] or width) for c, b in packed.items()}
        size = len(x["entry"])
        return cls(no, **x | {"vector": _unit(x["vector"].reshape(size, -1)), "code": x["code"].reshape(size, -1)})


def _compare(model: Quantiser, width: np.dtype):
    """A row holds two blocks. Emits for each entry the number of other vectors it links with there, and links
    that connect what is connected. A block that meets itself counts each pair from both of its ends."""

    def meet(held: Block, asked: Block) -> tuple[list, list, list]:
        least = np.float32(LEAST_COSINE - ROUNDING) - held.error[:, None]
        lists, first = np.unique(held.list, return_index=True)
        reach = np.concatenate([r for _, r in model.probes(asked.vector, asked.list, lists)])
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        nodes, near, counts = [], [], []
        total, back = np.zeros(len(asked.entry), np.int64), np.zeros(len(held.entry), np.int64)
        pieces = [(lst, slice(x, y), np.flatnonzero(reach[:, k])) for k, (lst, x, y) in enumerate(zip(lists, first, [*first[1:], len(held.list)], strict=True))]
        for lst, own, part in ((lst, own, k[j : j + 256]) for lst, own, k in pieces for j in range(0, len(k), 256)):
            q = asked.vector[part].astype(np.float32)
            score = np.repeat((q @ model.centers[lst])[None, :], own.stop - own.start, axis=0)
            for s, t in enumerate(model.tables(q)):
                score += t[held.code[own, s]]
            cols, rows = np.nonzero(score >= least[own])
            cols, rows = cols + own.start, part[rows]
            keep = _cosines(asked.vector, held.vector, rows, cols) >= LEAST_COSINE
            keep &= asked.entry[rows] != held.entry[cols]
            rows, cols = rows[keep], cols[keep]
            np.add.at(total, rows, held.n[cols])
            np.add.at(back, cols, asked.n[rows])
            for a, b in zip(asked.entry[rows].tolist(), held.entry[cols].tolist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    nodes.append(a), near.append(b), counts.append(0)
        for block, found in ((asked, total), (held, back))[: 1 if held.no == asked.no else 2]:
            for i in np.flatnonzero(found):
                nodes.append(int(block.entry[i])), near.append(None), counts.append(int(found[i]))
        return nodes, near, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, Block] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                for side in ("held", "asked"):
                    no = batch.column(f"{side}_no")[k].as_py()
                    if side not in last or last[side].no != no:
                        last[side] = Block.of(no, {c: batch.column(f"{side}_{c}")[k].as_py() for c in PACKED}, width)
                out = meet(last["held"], last["asked"])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["entry", "near", "links"])

    return run


@contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows, for what runs inside: a row may hold a block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def links(distinct: DataFrame) -> DataFrame:
    """entry, near, links of distinct vectors, written: rows without ``near`` are counts to be added up, the others links."""
    spark = distinct.sparkSession
    rows = distinct.count()
    width = np.dtype(np.float32 if dict(distinct.dtypes)["embedding"] == "array<float>" else np.float64)
    chosen = distinct.orderBy(F.xxhash64("entry", F.lit(5))).limit(FIT_ROWS) if rows > FIT_ROWS else distinct
    sample = _unit(np.array([r["embedding"] for r in chosen.select("entry", "embedding").collect()], width)) if rows else np.ones((1, 1))  # FIT_ROWS vectors at most
    model = Quantiser.fit(sample[: max(1, rows)], rows)
    arrow_batches(spark, 1024)
    coded = distinct.mapInArrow(_coded(model), "group long, list int, entry long, n long, vector binary, code binary, error float")
    # the groups are found twice, as writing every vector once more for their sizes would cost more
    size = min(BLOCK, max(64, BLOCK_BYTES // (sample.shape[1] * 8)))
    sizes = distinct.select("embedding").mapInArrow(_counted(model), "group long, n long").groupBy("group").agg(F.ceil(F.sum("n") / size).cast("long").alias("blocks"))
    # a row per group, at most MOST_LISTS; a vector between two lists may be found in either, so none is left to an inner join
    dealt = coded.join(F.broadcast(sizes), "group", "left").withColumn("block", F.pmod(F.xxhash64("entry"), F.coalesce("blocks", F.lit(1))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    packed = dealt.repartition(parts, "group", "block").sortWithinPartitions("group", "block").select("group", "block", *PACKED)
    blocks = shared(packed.mapInArrow(_pack(model, width), BLOCKS), "pq-blocks")
    held, asked = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("no", "group", "asks", *PACKED)]) for side in ("held", "asked"))
    met = held.hint("shuffle_replicate_nl").join(asked, (F.col("held_no") <= F.col("asked_no")) & F.array_contains("asked_asks", F.col("held_group").cast("int")))
    met = met.select(*[f"{side}_{c}" for side in ("held", "asked") for c in ("no", *PACKED)])
    with _batches_of(spark, 1):
        return shared(met.mapInArrow(_compare(model, width), "entry long, near long, links long"), "pq-links")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``vectors``."""
    distinct = shared(entries(vectors), "pq-entries")
    found = links(distinct)
    counts = found.where("near IS NULL").groupBy("entry").agg(F.sum("links").alias("links"))
    labels = components(found.where("near IS NOT NULL").select(F.col("entry").alias("a"), F.col("near").alias("b")))
    about = distinct.select("key", "entry", "n").join(counts, "entry", "left").join(labels, F.col("entry") == F.col("node"), "left")
    about = shared(about.select("key", F.coalesce("links", F.lit(0)).alias("links"), F.col("n").alias("copies"), F.coalesce("label", "entry").alias("component")), "pq-about")
    out = usable(vectors).select("vec_id", F.when(F.col("ok"), _key()).alias("key")).join(about, "key", "left")
    per_row = out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return per_row.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: DuckDB: every pair of usable vectors, then what can be reached over the links.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT m.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.c AS component_id, m.vec_id = m.c AS kept
FROM (SELECT vec_id, min(reach) AS c FROM r GROUP BY 1) m LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) k ON k.a = m.vec_id
"""
