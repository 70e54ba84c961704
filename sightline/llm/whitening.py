"""Whitening of vectors along the leading components of their covariance.

Method (Chebyshev-filtered subspace iteration). The covariance is never formed: a pass over
the data gives ``V Q = sum((x - mean) ((x - mean)' Q)) / n`` for a block ``Q``, with one
partial sum of fixed size per task, added up in two steps. A few Lanczos passes tell where
the spectrum ends below. A round applies a polynomial of ``V`` by the three-term Chebyshev
recurrence, a pass per degree, which keeps the unwanted interval small and lets the wanted
end grow; then QR and Rayleigh-Ritz (one more pass) give new estimates, whose residuals
``|V q - e q|`` are measured. The degree is chosen so that the largest component doesn't
drown the others in one round.

Certificate. Every wanted residual is below ``PRECISE`` of the largest eigenvalue (or has
stopped falling below ``ROUGH``), and a fresh random block across the components found,
filtered with the last of them as the border, shows no eigenvalue above it; if it does,
the block takes it in and the rounds go on. A block that doesn't get there in ``PATIENCE``
rounds is doubled, and one as wide as the vectors is exact after a pass, so it ends.

Entries are integers (``floor(SCALE * c)``), so sums, the trace and the deviations are exact.

Defined results: vectors that are null, empty or hold null or non-finite entries, and those
of another dimension than the most frequent one, are left out. Repeated rows and null ids
are returned row by row; for the fit equal vectors count once. Components of no variance
(below ``FLAT`` of the largest eigenvalue) aren't returned: a table of one distinct vector
gives no rows, nor does an empty one. Entries beyond a long are held at its ends; a
deviation beyond a long is null. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_batches, shared, table

SCALE, COMPONENTS = 256, 4
#: Columns of the block beyond the wanted ones, most degrees of a filter, Lanczos passes, rounds before the block is doubled.
SPARE, DEGREE, LANCZOS, PATIENCE = 12, 16, 8, 12
#: Residuals in shares of the largest eigenvalue; a component's least share of it.
PRECISE, ROUGH, FLAT = 4e-15, 1e-9, 1e-10
#: Most that a round may let the largest eigenvalue grow against the border, as a logarithm.
GROWTH = 18.0
#: Rows of a batch, and tasks that add up the partial sums.
ROWS, ADDERS = 4096, 8


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x (longs): the rows that remain."""
    c = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where("c IS NOT NULL AND size(c) > 0")
    rows = rows.where(~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE)).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: for every dimension the sum of the entries and of their squares."""
    n, s, q = 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch)
        if float(np.abs(x.astype(np.float64)).max()) ** 2 * len(x) > 2**62:
            x = x.astype(object)
        n, s, q = n + len(x), s + x.sum(axis=0).astype(object), q + (x * x).sum(axis=0).astype(object)
    if n:
        d = len(s)
        kind = pa.decimal128(38, 0)
        # squares in two halves: a decimal has 38 digits
        high, low = q // 10**18, q % 10**18
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), *(pa.array([Decimal(int(v)) for v in c], kind) for c in (s, high, low))], ["k", "n", "s", "high", "low"])


def _partial(block: np.ndarray, mean: np.ndarray, half: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = half(_matrix(batch) - mean, block)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column("part").to_pylist():
            own = np.frombuffer(part)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})


def _covered(x: np.ndarray, block: np.ndarray) -> np.ndarray:
    return x.T @ (x @ block)


def _squares(x: np.ndarray, block: np.ndarray) -> np.ndarray:
    y = x @ block
    return y.T @ y


@dataclass
class Centred:
    """The distinct vectors with exact count, sums and trace; products with their covariance are passes over them."""

    rows: DataFrame
    n: int
    sums: list[int]
    mean: np.ndarray
    trace: float
    passes: int = 0

    @classmethod
    def of(cls, rows: DataFrame) -> Centred:
        parts = rows.mapInArrow(_exact, "k int, n long, s decimal(38,0), high decimal(38,0), low decimal(38,0)")
        got = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("s", "high", "low")]).orderBy("k").collect()  # a row per dimension
        n = int(got[0]["n"]) if got else 0
        sums = [int(r["s"]) for r in got]
        square = sum(int(r["high"]) * 10**18 + int(r["low"]) for r in got)
        trace = Fraction(n * square - sum(s * s for s in sums), n * n) if n else Fraction(0)
        return cls(rows, n, sums, np.array([s / n for s in sums]), float(trace))

    def _sum(self, block: np.ndarray, half: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        parts = self.rows.mapInArrow(_partial(block, self.mean, half), "part binary")
        got = parts.repartition(ADDERS).mapInArrow(_added, "part binary").collect()  # ADDERS rows at most
        return sum(np.frombuffer(r["part"]).reshape(shape) for r in got) / self.n

    def times(self, block: np.ndarray) -> np.ndarray:
        """``V block``."""
        self.passes += 1
        return self._sum(block, _covered, block.shape)

    def covariance(self, block: np.ndarray) -> np.ndarray:
        """Covariance of the vectors projected on ``block``."""
        return self._sum(block, _squares, (block.shape[1], block.shape[1]))


def lowest(v: Centred, d: int, rng: np.random.Generator) -> float:
    """A value near the smallest eigenvalue, from a few Lanczos passes with full orthogonalisation."""
    basis = [rng.standard_normal(d)]
    basis[0] /= np.linalg.norm(basis[0])
    diagonal, beside = [], []
    for _ in range(min(LANCZOS, d)):
        y = v.times(basis[-1][:, None])[:, 0]
        diagonal.append(float(basis[-1] @ y))
        for _ in range(2):
            for b in basis:
                y = y - (b @ y) * b
        beside.append(float(np.linalg.norm(y)))
        if beside[-1] <= 1e-12 * abs(diagonal[0]):
            break
        basis.append(y / beside[-1])
    k = len(diagonal)
    value, vector = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[: k - 1], 1) + np.diag(beside[: k - 1], -1))
    return max(0.0, float(value[0] - beside[-1] * abs(vector[-1, 0])))


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial that is small on [low, cut], scaled to one at ``top``, of the covariance times ``block``."""
    half, centre = (cut - low) / 2, (cut + low) / 2
    first = sigma = half / (top - centre)
    before, now = block, (times(block) - centre * block) * (sigma / half)
    for _ in range(2, degree + 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def _degree(low: float, cut: float, top: float) -> int:
    reach = np.arccosh(1 + 2 * (top - cut) / (cut - low)) if top > cut else 0.0
    return int(np.clip(GROWTH / reach if reach > 0 else DEGREE, 2, DEGREE))


def _ritz(v: Centred, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orthonormal basis, eigenvalue estimates (falling), vectors, residuals."""
    q, _ = np.linalg.qr(block)
    q, _ = np.linalg.qr(q)
    y = v.times(q)
    h = q.T @ y
    value, turn = np.linalg.eigh((h + h.T) / 2)
    value, turn = value[::-1], turn[:, ::-1]
    vectors = q @ turn
    return value, vectors, np.linalg.norm(y @ turn - vectors * value, axis=0)


@dataclass
class Components:
    """Unit eigenvectors in columns, their eigenvalues and residuals, and how many passes it took."""

    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    passes: int


def leading(v: Centred, wanted: int = COMPONENTS) -> Components:
    """The certified leading components of the covariance."""
    d = len(v.sums)
    rng = np.random.default_rng(20)
    wanted = min(wanted, d)
    if v.trace <= 0:
        return Components(np.zeros((d, 0)), np.zeros(0), np.zeros(0), v.passes)
    width = min(d, wanted + SPARE)
    low = lowest(v, d, rng) if width < d else 0.0
    value, block, residual = _ritz(v, rng.standard_normal((d, width)))
    last, rounds = np.inf, 0
    while True:
        top = float(value[0])
        worst = float(residual[:wanted].max()) / top
        whole = block.shape[1] == d
        done = worst <= PRECISE or (worst <= ROUGH and worst > 0.5 * last) or whole
        if done and not whole:
            found = block[:, :wanted]
            border = float(value[wanted - 1])
            across = lambda x: x - found @ (found.T @ x)  # noqa: B023, E731
            start = np.linalg.qr(across(rng.standard_normal((d, wanted))))[0]
            if border - low > 1e-9 * top:
                start = across(filtered(lambda x: across(v.times(across(x))), start, 8, low, border, border * 1.05))  # noqa: B023
            other, more, _ = _ritz(v, start)
            if other[0] <= border + 1e-12 * top:
                break
            value, block, residual = _ritz(v, np.hstack([block, more]))  # one was missed
            last, rounds = np.inf, 0
            continue
        if done:
            break
        last, rounds = worst, rounds + 1
        if rounds % PATIENCE == 0:
            wider = min(d, 2 * block.shape[1])
            value, block, residual = _ritz(v, np.hstack([block, rng.standard_normal((d, wider - block.shape[1]))]))
            last = np.inf
            continue
        cut = max(float(value[-1]), low + 1e-9 * top)
        degree = _degree(low, cut, top)
        value, block, residual = _ritz(v, filtered(v.times, block, degree, low, cut, max(top, cut + 1e-9 * top)))
    keep = int((value[:wanted] > FLAT * value[0]).sum())
    return Components(block[:, :keep], value[:keep], residual[:keep], v.passes)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    top = n * float(np.abs(x.astype(np.float64)).max()) + max(abs(s) for s in sums)
    if top * top * x.shape[1] < 2**62:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [e if e < 2**63 else None for e in exact]


def _projected(v_n: int, sums: list[int], mean: np.ndarray, found: Components, trace: float, error: float):
    k = len(found.values)
    scaled = found.vectors / np.sqrt(found.values)
    explained = found.values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch)
            m = len(x)
            rows = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, v_n, np.int64)),
                    pa.array(_deviations(x, v_n, sums), pa.int64()).take(pa.array(rows)),
                    pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def fit(vectors: DataFrame, wanted: int = COMPONENTS) -> tuple[DataFrame, Centred, Components]:
    """The remaining rows (vec_id, x) as a table, the distinct vectors, and their leading components."""
    arrow_batches(vectors.sparkSession, ROWS)
    rows = shared(integers(vectors), "whiten-rows")
    width = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()  # one row
    rows = rows.where(F.size("x") == (width[0]["d"] if width else 0))
    v = Centred.of(shared(rows.select("x").distinct(), "whiten-fit"))
    return rows, v, leading(v, wanted)


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per remaining row and component."""
    rows, v, found = fit(vectors, wanted)
    k = len(found.values)
    error = float(np.abs(v.covariance(found.vectors / np.sqrt(found.values)) - np.eye(k)).max()) if k else 0.0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_projected(v.n, v.sums, v.mean, found, v.trace, error), schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
