"""Whitening against numpy's eigenvectors and exact whole numbers."""

import math

import numpy as np
import pytest

from warpwise.llm import whitening
from warpwise.llm.queries import op12_whitening


def numbers(vector):
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return tuple(math.floor(256 * float(c)) for c in vector)


def plain(vectors):
    """Per remaining vector its deviation and whitened values (up to sign), and eigenvalues, all from the covariance matrix."""
    made = {i: numbers(v) for i, v in enumerate(vectors)}
    longest = max((len(x) for x in made.values() if x), default=0)
    made = {i: x for i, x in made.items() if x is not None and len(x) == longest}
    distinct = sorted(set(made.values()))
    n, sums = len(distinct), [sum(column) for column in zip(*distinct)]
    centred = np.array([[float(c) - s / n for c, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in made.items()}
    white = {i: (np.array([c - s / n for c, s in zip(x, sums)]) @ vectors)[:4] / np.sqrt(np.maximum(values[:4], 1e-300)) for i, x in made.items()}
    return n, deviation, white, values


def check(rows, vectors, components=4):
    n, deviation, white, values = plain(vectors)
    found = {}
    for r in rows:
        found.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    assert set(found) == {(i, c) for i in deviation for c in range(1, components + 1)}
    for c in range(1, components + 1):
        own, wanted = np.array([found[i, c][0]["whitened"] for i in white]), np.array([w[c - 1] for w in white.values()])
        sign = np.sign(own @ wanted)
        assert np.abs(own * sign - wanted).max() < 1e-8


def table(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)


def run(spark, vectors):
    docs = table(spark, vectors)
    return whitening.whitened(docs, whitening.fit(docs), keep=["vec_id"]).collect()


def test_equals_the_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 9)) * np.geomspace(2, 0.1, 9) @ np.linalg.qr(rng.standard_normal((9, 9)))[0] + 40).tolist()
    vectors += vectors[:60] * 3  # copies count once in the fit
    vectors += [None, [], [None] * 9, [math.nan] * 9, [math.inf] + [0.0] * 8, [1.0, 2.0]]
    check(run(spark, vectors), vectors)


def test_rank_below_four(spark):
    rng = np.random.default_rng(2)
    flat = (np.round(rng.standard_normal((80, 2)) * 8) @ np.array([[1, 0, 1, 0, 2], [0, 1, 1, 2, 0]])).tolist()
    check(run(spark, flat), flat, 2)


def test_equal_eigenvalues(spark):
    corners = [[s * (k == j) for k in range(5)] for j in range(5) for s in (1.0, -1.0)]
    rows = run(spark, corners)
    white = np.array([[r["whitened"] for r in sorted(rows, key=lambda r: r["component"]) if r["vec_id"] == i] for i in range(10)])
    assert white.shape == (10, 4) and np.abs(white.T @ white / 10 - np.eye(4)).max() < 1e-9
    assert all(r["explained"] == pytest.approx(0.2) for r in rows)


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_variance(spark, vectors):
    docs = table(spark, vectors)
    out = whitening.whitened(docs, whitening.fit(docs), keep=["vec_id"])
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_are_exact_or_null(spark):
    large = [[float(1 << 40), 0.0], [0.0, 1.0], [0.0, 0.0]]
    rows = run(spark, large)
    assert [r["deviation"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["component"] == 1] == [None, None, None]
    check(run(spark, [[v * 2.0**12 for v in x] for x in ([1.5, 2.25], [8.0, 1.0], [3.0, 3.0])]), [[v * 2.0**12 for v in x] for x in ([1.5, 2.25], [8.0, 1.0], [3.0, 3.0])], 2)


def test_many_dimensions_end_on_convergence(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FULL_STEPS", 10)
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((400, 40)) * np.concatenate([[9, 7, 5, 4], np.full(36, 0.1)])).tolist()
    check(run(spark, vectors), vectors)


def test_other_columns_are_carried(spark):
    docs = table(spark, [[1.0, 2.0], [2.0, 0.5], [0.0, 1.0]]).selectExpr("*", "'a' as row", "'b' as x", "'c' as N", "'d' as white", "'e' as at")
    out = whitening.whitened(docs, whitening.fit(docs))
    assert out.columns[:6] == ["vec_id", "embedding", "row", "x", "white", "at"] and "N" not in out.columns
    assert {(r["row"], r["x"], r["white"], r["at"]) for r in out.collect()} == {("a", "b", "d", "e")}


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = op12_whitening(spark, folder).collect()
    order = {r["vec_id"]: i for i, r in enumerate(rows)}
    check([{**r.asDict(), "vec_id": order[r["vec_id"]]} for r in found], [r["embedding"] for r in rows])
