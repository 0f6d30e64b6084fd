"""Embedding whitening against NumPy's eigenvectors of the covariance."""

import numpy as np
import pytest

from tidewell.llm import whitening as W

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("vec_id", "embedding", "1 as id", "2 as dim", "'x' as x", "3 as component", "4 as n").repartition(3)


def truth(vectors, wanted=16):
    """By NumPy: ids are places in the list."""
    x = np.floor(np.array(vectors, float) * 64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    v = (fit - mean).T @ (fit - mean) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    s = fit.astype(object).sum(axis=0)
    return n, (x - mean) @ q / np.sqrt(e), e / np.trace(v), [int(((n * row.astype(object) - s) ** 2).sum()) for row in x]


def check(got, ids, vectors, wanted=16):
    n, w, share, deviation = truth(vectors, wanted)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(ids) * w.shape[1]
    mine = np.array([[by[i][k + 1]["whitened"] for k in range(w.shape[1])] for i in ids])
    assert np.abs(mine * np.sign((mine * w).sum(axis=0)) - w).max() < 1e-8
    for i, d in zip(ids, deviation):
        assert all(r["n"] == n and r["deviation"] == d and r["identity_error"] < 1e-10 for r in by[i].values())
        assert np.allclose([by[i][k + 1]["explained"] for k in range(len(share))], share, rtol=1e-9)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((120, 24)) * np.linspace(0.2, 2, 24)).astype(np.float32)
    vectors = base.tolist() + [base[3].tolist()] * 40  # a hot vector counts once
    odd = [(900, None), (901, [float("nan")] + [0.0] * 23), (902, [float("inf")] + [0.0] * 23), (903, [None] + [0.0] * 23), (904, [])]
    df = frame(spark, list(enumerate(vectors)) + odd)
    out = W.whiten(df)
    assert out.columns == COLUMNS
    check(out.collect(), range(len(vectors)), vectors)


def test_few_entries_and_repeated_ids(spark):
    vectors = [[0.5, -1.0, 3.0], [2.0, 0.0, 1.0], [1.0, 1.0, -1.0], [0.0, 0.25, 0.5], [7.0, 2.0, 2.0]]
    check(W.whiten(frame(spark, list(enumerate(vectors)), "double")).collect(), range(5), vectors)
    rows = [(None, vectors[0]), (1, vectors[1]), (1, vectors[2]), (4, vectors[3]), (None, vectors[4])]
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 15 and sum(r["vec_id"] is None for r in got) == 6 and sum(r["vec_id"] == 1 for r in got) == 6


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]):
        assert W.whiten(frame(spark, rows)).collect() == []


def test_lengths_are_whitened_by_themselves(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((30, 4)), rng.standard_normal((20, 6))
    got = W.whiten(frame(spark, list(enumerate(a.tolist())) + [(100 + k, v) for k, v in enumerate(b.tolist())], "double")).collect()
    check([r for r in got if r["vec_id"] < 100], range(30), a)
    check([r for r in got if r["vec_id"] >= 100], range(100, 120), b)


def test_large_entries(spark):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((40, 3)) * 1e9  # products beyond the exact range of doubles, deviations beyond long
    got = W.whiten(frame(spark, list(enumerate(v.tolist())), "double")).collect()
    n, w, share, _ = truth(v)
    mine = np.array([[r["whitened"] for r in sorted((r for r in got if r["vec_id"] == i), key=lambda r: r["component"])] for i in range(40)])
    assert np.abs(mine * np.sign((mine * w).sum(axis=0)) - w).max() < 1e-8 and got[0]["deviation"] is None and got[0]["identity_error"] < 1e-10
    ends = W.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "double")).collect()
    assert {r["vec_id"] for r in ends} == {1, 2, 3}


@pytest.mark.parametrize("m", [np.eye(20), np.diag([9.0] * 3 + [1.0] * 17), np.diag(10.0 ** -np.arange(30)), np.zeros((4, 4)), np.array([[0.0, 1.0], [1.0, 0.0]])], ids=["equal", "groups", "steep", "zero", "indefinite"])
def test_slices_hold_all_eigenvalues(m):
    e = np.sort(np.linalg.eigvalsh(m))[::-1]
    found = []
    for low, high, n in W.slices(m, min(16, len(m))):
        assert n == ((e > low) & (e < high)).sum()
        values, vectors = W.feast(m, low, high, n)
        assert len(values) == n and np.abs(m @ vectors - vectors * values).max() < 1e-12
        found += values.tolist()
    found = np.sort(found)[::-1]
    assert np.allclose(found, e[: len(found)], atol=1e-13)


def test_inertia():
    rng = np.random.default_rng(8)
    for d in (1, 2, 7, 25):
        for _ in range(20):
            a = rng.integers(-2, 3, (d, d)).astype(float)
            a = a + a.T
            s = rng.uniform(-3, 3)
            assert W.inertia(a, s) == (np.linalg.eigvalsh(a) > s).sum()
