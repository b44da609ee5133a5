"""Whitened embeddings against exact integers and a library's eigenvectors of the same covariance."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
from conftest import SF

from tickloom.llm import queries
from tickloom.llm import whitening as W


def brute(rows, k, scale=1024.0, shift=100_000):
    """(n, {position: (deviation, whitened)}, variances, trace) of (position, vector) rows."""
    good = [(i, v) for i, v in rows if v and all(c is not None and abs(c) < inf for c in v)]
    sizes = [len(v) for _, v in good]
    dim = max(sizes, key=lambda s: (sizes.count(s), s), default=0)
    x = {i: [floor(scale * c) + shift for c in v] for i, v in good if len(v) == dim}
    n, sums = len(x), [sum(c) for c in zip(*x.values())]
    y = {i: [float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for i, v in x.items()}
    m = np.array(list(y.values()))
    cov = m.T @ m / n
    e, z = np.linalg.eigh(cov)
    e, z = e[::-1][:k], z[:, ::-1][:, :k]
    keep = e > dim * 2.0**-39 * e[0]
    out = {i: (sum((n * c - s) ** 2 for c, s in zip(x[i], sums)), np.array(v) @ z[:, keep] / np.sqrt(e[keep])) for i, v in y.items()}
    return n, out, e[keep], np.trace(cov)


def compare(rows, df, k=8, tol=1e-9):
    m = W.fit(df, "embedding", k)
    n, want, e, trace = brute(rows, k)
    assert m.n == n and m.variances == pytest.approx(e, rel=1e-9) and m.trace == pytest.approx(trace)
    got = {r.at: r._white for r in W.transform(df, m).collect()}
    assert set(got) == set(want)
    for i, (deviation, w) in want.items():
        assert got[i].deviation == deviation and len(got[i]["values"]) == len(e)
    if len(e):
        a, b = np.array([got[i]["values"] for i in want]), np.array([w for _, w in want.values()])
        a, b = a * np.sign((a * b).sum(axis=0)), b
        assert np.abs(a - b).max() < tol
        assert W.identity_error(df, m) < 1e-9
    return m, got


def frame(spark, vectors, kind="double"):
    rows = [(i % 7 if i % 5 else None, i, v, "x", i) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"vec_id long, at int, embedding array<{kind}>, row string, v int").repartition(4)
    return [(i, v) for i, v in enumerate(vectors)], df


def random_vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ np.diag(np.linspace(1, 0.1, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 5).tolist()


@pytest.mark.parametrize("n,d", [(300, 12), (5, 12), (40, 3), (60, 1)])
def test_whitened_rows(spark, n, d):
    compare(*frame(spark, random_vectors(n, d)))


def test_odd_vectors(spark):
    vectors = random_vectors(80, 6) + [None, [], [1.0] * 5 + [None], [nan] * 6, [inf] + [0.0] * 5, [1.0, 2.0], [0.5] * 6, [0.5] * 6]
    m, got = compare(*frame(spark, vectors))
    assert m.n == 82 and len(got) == 82


def test_equal_vectors_have_no_component(spark):
    m, got = compare(*frame(spark, [[1.0, 2.0]] * 9))
    assert m.variances.size == 0 and all(w["values"] == [] and w.deviation == 0 for w in got.values())
    m, got = compare(*frame(spark, [[1.0, 2.0]]))
    assert len(got) == 1


def test_nothing_to_fit(spark):
    _, df = frame(spark, [None, [nan]])
    m = W.fit(df)
    assert m.n == 0 and W.identity_error(df, m) == 0 and W.transform(df, m).count() == 0
    assert W.fit(df.where("false")).n == 0


def test_huge_entries(spark):
    _, df = frame(spark, [[1e300, -1e300, 1.0], [3e15, 2.0, 5.0], [1e12, 4.0, 2.0]])
    m = W.fit(df)
    rows = W.transform(df, m).collect()
    assert len(rows) == 3 and all(np.isfinite(r._white["values"]).all() for r in rows) and any(r._white.deviation is None for r in rows)


def test_large_whole_numbers_are_exact(spark):
    """Deviations between the fast path's bound and a long's."""
    rows, df = frame(spark, [[i * 100.0, (i * i % 17) * 90.0] for i in range(200)])
    _, got = compare(rows, df, tol=1e-6)
    assert max(w.deviation for w in got.values()) > 1 << 53


def test_float_vectors_and_partitions(spark):
    vectors = np.array(random_vectors(100, 4), np.float32).tolist()
    rows, df = frame(spark, vectors, "float")
    a, _ = compare(rows, df)
    b = W.fit(df.repartition(1))
    assert a.sums == b.sums and (a.components == b.components).all() and (a.variances == b.variances).all()


MATRICES = {
    "identity": np.eye(10), "blocks": np.kron(np.eye(2), np.ones((6, 6))), "equal": np.diag([5.0, 5, 5, 1, 1, 0, 0]), "rank one": np.ones((6, 6)),
    "wilkinson": np.diag(np.abs(np.arange(21) - 10.0)) + np.eye(21, k=1) + np.eye(21, k=-1), "small": np.eye(5) * 1e-300, "large": np.eye(5) * 1e300,
    "graded": (lambda q: q @ np.diag(10.0 ** -np.arange(40)) @ q.T)(np.linalg.qr(np.random.default_rng(1).normal(size=(40, 40)))[0]),
    "cluster": (lambda q: q @ np.diag([10.0] * 5 + [10 - 1e-12] * 5 + list(np.linspace(1, 2, 30))) @ q.T)(np.linalg.qr(np.random.default_rng(2).normal(size=(40, 40)))[0]),
}


@pytest.mark.parametrize("name", list(MATRICES))
def test_solver(name):
    a = MATRICES[name]
    e, z = W.components(a, 12)
    size = np.abs(a).max()
    want = np.linalg.eigvalsh(a)[::-1][:min(12, len(a))]
    assert e == pytest.approx(want[want > len(a) * 2.0**-39 * want[0]], abs=1e-13 * size)
    assert np.abs(a @ z - z * e).max() < 1e-13 * size and np.abs(z.T @ z - np.eye(len(e))).max() < 1e-13


def test_sturm_counts():
    rng = np.random.default_rng(4)
    diag, off = rng.normal(size=30), rng.normal(size=29)
    e = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    x = np.concatenate([e - 1e-9, e + 1e-9])
    assert (W.below(diag, off, x) == np.array([(e < v).sum() for v in x])).all()


def test_query(spark):
    rows = queries.QUERIES["op12_embedding_whitening"](spark, SF).collect()
    vecs = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, want, e, trace = brute(vecs, 8)
    assert len(rows) == 8 * n and {r.component for r in rows} == set(range(1, 9))
    by = {(r.vec_id, r.component): r for r in rows}
    for c in range(1, 9):
        a = np.array([by[i, c].whitened for i in want])
        b = np.array([w[c - 1] for _, w in want.values()])
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-9
    assert all(r.n == n and r.deviation == want[r.vec_id][0] and r.explained == pytest.approx(e[r.component - 1] / trace) and r.identity_error < 1e-9 for r in rows)
