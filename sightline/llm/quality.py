"""Document quality by a regularised quadratic discriminant over statistics of the text.

Method. Each whole text gives a fixed vector of transformed statistics. For each class
the mean and a covariance shrunk towards its own diagonal are estimated from sums that
Spark adds up; the Cholesky factors are computed once and travel with the scoring
function. The score is the logistic of the difference of the two Gaussian
log-densities (Mahalanobis distances through the cached factors) plus the log prior.

Defined results: null and empty texts have the statistics of an empty text and get a
score like any other; a null label is no label; a document with several labels counts
once for each distinct one. Without labelled rows of both classes every score is the
share of label 1 (0.5 without labels). ``labels``, ``lang``, ``source`` and ``doc_id``
never enter a score; ``doc_id`` only decides what is held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_batches, shared, table

#: Share of the diagonal in each class covariance, and a floor on its variances.
SHRINKAGE, FLOOR = 0.02, 1e-4
#: Words of usual text that every text is counted with, so that shares of short ones aren't extreme.
BEFORE = 10

_GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?", "shout": b"!", "mark": b"#$%&*@^~+=<>\\/_", "bar": b"|[]{}()", "line": b"\n", "blank": b" \t\r\x0b\x0c"}
_CLASS = np.full(256, len(_GROUPS))
for _k, _bytes in enumerate(_GROUPS.values()):
    _CLASS[list(_bytes)] = _k

FEATURES = ("words", "word_size", "word_spread", "distinct", "top_word", "short", "upper", "digit", "stop", "shout", "mark", "bar", "repeated_lines", "lines", "marked_words", "capital_words", "pairs", "line_spread")


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    tally = Counter(words)
    by = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=len(_GROUPS) + 1)
    upper, lower, digit, stop, shout, mark, bar, line, blank, wide = by
    ink, letters = by.sum() - line - blank, upper + lower + wide
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    first, last = Counter(w[0] for w in words), Counter(w[-1] for w in words)
    marked = sum(v for k, v in last.items() if _CLASS[k] in (4, 5, 6))
    capital = sum(v for k, v in first.items() if _CLASS[k] == 0)
    per_line = np.fromiter((x.count(b" ") + 1 for x in lines), np.int64, len(lines))
    pairs = len(set(zip(words, words[1:], strict=False)))

    def share(count: float, of: float, usual: float, weight: float = BEFORE) -> float:
        """Logarithm of a share, drawn to the usual one where there is little text to count in."""
        return np.log((count + weight * usual) / (of + weight) + 0.01)

    size = (sizes.sum() + 5.5 * BEFORE) / (n + BEFORE)
    spread = np.sqrt((((sizes - size) ** 2).sum() + 9 * BEFORE) / (n + BEFORE))
    return np.array(
        [
            np.log1p(n),
            np.log(size),
            np.log1p(spread),
            np.log((len(tally) + BEFORE) / (n + BEFORE)),
            share(max(tally.values(), default=0), n, 0.05),
            share((sizes <= 3).sum(), n, 0.4),
            share(upper, letters, 0.03, 6 * BEFORE),
            share(digit, ink, 0, 6 * BEFORE),
            share(stop, ink, 0.02, 6 * BEFORE),
            share(shout, ink, 0, 6 * BEFORE),
            share(mark, ink, 0, 6 * BEFORE),
            share(bar, ink, 0, 6 * BEFORE),
            share(len(lines) - len(set(lines)), len(lines), 0, 3),
            share(len(lines), n, 0.02),
            share(marked, n, 0),
            share(capital, n, 0.08),
            np.log((pairs + BEFORE) / (max(n - 1, 0) + BEFORE)),
            np.log1p(per_line.std()) - np.log1p(per_line.mean()) if len(lines) else 0.0,
        ]
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: count, sum of the vectors, sum of their outer products."""
    d = len(FEATURES)
    total = {k: [0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
    for batch in batches:
        x = np.array(batch.column("x").to_pylist()).reshape(-1, d)
        y = np.array(batch.column("quality").to_pylist())
        for k, t in total.items():
            own = x[y == k]
            t[0] += len(own)
            t[1] += own.sum(axis=0)
            t[2] += own.T @ own
    yield pa.RecordBatch.from_pydict({"quality": pa.array([0, 1], pa.int32()), "n": pa.array([t[0] for t in total.values()], pa.int64()), "s": pa.array([[*t[1], *t[2].ravel()] for t in total.values()], pa.list_(pa.float64()))})


@dataclass
class Discriminant:
    """Means, Cholesky factors, log-determinants and prior of the two classes; no factors: a constant."""

    prior: float
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.prior)
        dens = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            dens.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        gap = dens[1] - dens[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -700, 700)))


def fit(rows: DataFrame) -> Discriminant:
    """Fit on ``rows`` (x, quality); only sums of fixed size reach the driver, added pairwise by Spark."""
    arrow_batches(rows.sparkSession, 4096)
    d = len(FEATURES)
    parts = rows.where("quality IN (0, 1)").select("x", F.col("quality").cast("int").alias("quality")).mapInArrow(_sums, "quality int, n long, s array<double>")
    flat = parts.select("quality", "n", F.posexplode("s").alias("k", "v")).groupBy("quality", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    got = {(r["quality"], r["k"]): r for r in flat.collect()}  # 2 * (d + d * d) rows, whatever the input
    n = [got[k, 0]["n"] if (k, 0) in got else 0 for k in (0, 1)]
    if min(n) < 2:
        return Discriminant(n[1] / sum(n) if sum(n) else 0.5)
    means, factors = [], []
    for k in (0, 1):
        v = np.array([got[k, i]["v"] for i in range(d + d * d)])
        mean = v[:d] / n[k]
        cov = v[d:].reshape(d, d) / n[k] - np.outer(mean, mean)
        cov = (1 - SHRINKAGE) * cov + SHRINKAGE * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
        means.append(mean)
        factors.append(np.linalg.cholesky(cov))
    return Discriminant(n[1] / sum(n), means, factors)


def _scorer(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return run


def held_out(doc_id):
    """True where crc32 of the id as text leaves 1 modulo 3; such labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all labelled rows of ``vectors`` (doc_id, x) that aren't held out, so that the prior is theirs."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id"))).distinct()
    return fit(vectors.join(known, "doc_id"))


def vectors_of(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every row, as a table in the shared folder."""
    arrow_batches(docs.sparkSession)
    return shared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_rows, "doc_id long, x array<double>"), "quality-vectors")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``."""
    vectors = vectors_of(docs)
    model = train(vectors, labels)
    arrow_batches(docs.sparkSession)
    out = vectors.mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    The statistics are made anew for the decision: that costs CPU, where joining
    the scores would shuffle every text.
    """
    model = train(vectors_of(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
