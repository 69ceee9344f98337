import numpy as np
import pytest

from tallyspark.llm import whitening


def brute(vectors, components=16):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return n, x, s, e, w, np.trace(v)


def check(rows, ids, vectors):
    n, x, s, e, w, trace = brute(vectors)
    want = (x - s / n) @ w / np.sqrt(e)
    at = {i: k for k, i in enumerate(ids)}
    assert len(rows) == len(ids) * len(e)
    got = np.empty_like(want)
    for r in rows:
        k, c = at[r["vec_id"]], r["component"] - 1
        got[k, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum(int(d) ** 2 for d in n * x[k] - s)
        assert abs(r["explained"] - e[c] / trace) < 1e-10 * r["explained"] + 1e-15 and r["identity_error"] < 1e-8
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-6


@pytest.mark.parametrize("n", [1, 2, 3, 16, 64, 150])
def test_eigen_equals_numpy(n):
    r = np.random.default_rng(n)
    a = r.standard_normal((n, 3 * n))
    for m in (a @ a.T, np.diag(np.arange(n) % 3.0), np.ones((n, n)), a @ a.T + 1e4 * np.outer(a[:, 0], a[:, 0])):
        e, v = whitening.eigen(m, 16)
        want = np.linalg.eigvalsh(m)[::-1][:16]
        scale = max(np.abs(want).max(), 1e-300)
        assert np.abs(e - want).max() < 1e-12 * scale and np.abs(m @ v - v * e).max() < 1e-11 * scale
        assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12


def test_eigenvalue_at_the_mean():
    r = np.random.default_rng(0)
    q = np.linalg.qr(r.standard_normal((9, 9)))[0]
    m = (q * np.repeat([0.0, 1.0, 2.0], 3)) @ q.T
    e, v = whitening.eigen(m, 9)
    assert np.abs(e - np.repeat([2.0, 1.0, 0.0], 3)).max() < 1e-12 and np.abs(m @ v - v * e).max() < 1e-12


def test_polar_factor():
    r = np.random.default_rng(1)
    a = r.standard_normal((20, 20))
    a = a + a.T
    u = whitening.polar(a)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-12 and np.linalg.eigvalsh(u @ a).min() > 0


def test_query_on_whole_table(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    data = table.select("vec_id", "embedding").collect()
    check(whitening.query(table).collect(), [r["vec_id"] for r in data], [r["embedding"] for r in data])


def test_small_vectors(spark):
    kind = "vec_id long, embedding array<float>, n int, component string, v int"
    r = np.random.default_rng(2)
    base = r.standard_normal((30, 5)).astype(np.float32).tolist()
    good = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(40)]  # copies count once in the fit
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("inf")] + [0.0] * 4), (204, []), (205, [1.0, 2.0]), (206, [3e38] * 5)]
    make = lambda rows: spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], kind).repartition(4)
    check(whitening.query(make(good + odd)).collect(), [i for i, _ in good], [v for _, v in good])
    assert whitening.query(make([])).count() == 0
    assert whitening.query(make(odd[:5])).count() == 0
    assert whitening.query(make([(1, base[0]), (2, base[0])])).count() == 0
    twice = whitening.query(make(good + [(None, base[1]), (1, base[1])])).collect()
    assert len(twice) == 5 * (len(good) + 2)


def test_large_numbers_are_exact():
    x = np.array([[3 << 59, 1], [5, 2]], np.int64)
    d = whitening._differences(x, 7, np.array([10, 20]))
    assert d.tolist() == [[7 * (3 << 59) - 10, -13], [25, -6]] and whitening._deviations(d) == [None, 25 * 25 + 36]
