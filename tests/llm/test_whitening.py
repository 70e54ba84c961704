"""Whitening against a full eigendecomposition in numpy."""

import numpy as np
import pytest

from sightline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in rows], SCHEMA)


def expected(rows, wanted=4):
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:wanted], vector[:, ::-1][:, :wanted]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vector / np.sqrt(value), value / np.trace(v)


def compare(got, rows, wanted=4, close=1e-8):
    n, deviation, white, explained = expected([v for _, v in rows], wanted)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == len(rows) * wanted
    for k in range(wanted):
        own = np.array([by[i, k + 1]["whitened"] for i, _ in rows])
        sign = np.sign(own @ white[:, k])
        assert np.abs(own * sign - white[:, k]).max() < close
    for j, (i, _) in enumerate(rows):
        r = by[i, 1]
        assert (r["n"], r["deviation"]) == (n, deviation[j])
    assert all(abs(by[rows[0][0], k + 1]["explained"] - explained[k]) < 1e-12 for k in range(wanted))
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("kind", ["even", "spiked", "low rank"])
def test_components_match_eigh(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 24)) / 6
    if kind == "spiked":
        x[:, 0] *= 30
        x[:, 1] *= 4
    if kind == "low rank":
        x = rng.standard_normal((700, 5)) @ rng.standard_normal((5, 24)) / 10
    x = np.float32(x)
    rows = [(i, list(v)) for i, v in enumerate(x)] + [(1000, list(x[0])), (1001, list(x[0]))]
    compare(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_a_start_across_the_leading_component_is_found_out(spark, monkeypatch):
    """The certificate finds a component that the block doesn't hold at all."""
    x = np.random.default_rng(5).standard_normal((300, 30)) / 10
    x[:, 7] *= 9
    rows = [(i, list(np.float32(v))) for i, v in enumerate(x)]
    monkeypatch.setattr(whitening, "SPARE", 1)
    compare(whitening.whiten(frame(spark, rows), 3).collect(), rows, 3)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, list(np.float32(rng.standard_normal(6)))) for i in range(30)]
    odd = [(100, None), (101, []), (102, [None] * 6), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (105, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, good + odd)).collect()
    compare(got, good)
    got = whitening.whiten(frame(spark, [*good, (None, good[0][1])])).collect()
    assert sum(r["vec_id"] is None for r in got) == 4


def test_few_dimensions_few_rows_and_no_rows(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, -1.0])]
    compare(whitening.whiten(frame(spark, rows)).collect(), rows, 2)
    line = whitening.whiten(frame(spark, [(1, [1.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9)), round(r["explained"], 9)) for r in line) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_huge_entries(spark):
    got = whitening.whiten(frame(spark, [(1, [3e30, 1.0]), (2, [1.0, 2.0]), (3, [-3e30, 0.0])])).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(r["deviation"] is None for r in got if r["vec_id"] != 2)
