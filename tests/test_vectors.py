"""Singular vectors that are settled, and ranks by blocks, against dense numpy."""

import numpy as np
import pytest

from graphloom.operators import graph as G
from graphloom.operators import walks


def test_settled_singular_vectors_of_a_flat_spectrum(spark):
    rng = np.random.default_rng(2)
    n, m, k = 120, 80, 10
    u, v = (np.linalg.qr(rng.standard_normal((x, m)))[0] for x in (n, m))
    s = np.linspace(1.0, 0.6, m)
    a = u * s @ v.T
    matrix = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(m)], "i long, j long, w double")
    rows, columns, got = walks.singular(matrix, k, tol=1e-4)
    assert np.allclose(got, s[:k], atol=1e-5)
    rows, columns = ({r.id: np.array(r.x) for r in t.collect()} for t in (rows, columns))
    x, y = np.array([rows[i] for i in range(n)]), np.array([columns[j] for j in range(m)])
    assert np.allclose(y.T @ y, np.eye(k), atol=1e-9) and np.allclose(a @ y, x, atol=1e-9)
    new = spark.createDataFrame([(0, 3, 2.0), (0, 5, -1.0), (1, 99, 1.0)], "i long, j long, w double")
    seen = {r.id: r.x for r in walks.projected(new, spark.createDataFrame([(j, y[j].tolist()) for j in range(m)], "id long, x array<double>")).collect()}
    assert set(seen) == {0} and np.allclose(seen[0], 2 * y[3] - y[5])


def test_unsettled_vectors_are_an_error(spark):
    a = np.random.default_rng(0).standard_normal((40, 40))
    matrix = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(40)], "i long, j long, w double")
    with pytest.raises(ValueError, match="not settled"):
        walks.singular(matrix, 3, rounds=1, spare=1, tol=1e-9)
    assert walks.singular(matrix.limit(0), 3)[2] == []


def test_best_ranks_equal_sorting(spark):
    """Ties, NaN, positives out of the pool or without a vector, sources in the pool, several tiles."""
    rng = np.random.default_rng(1)
    n = 2600
    x = np.round(rng.standard_normal((n, 2)), 1)
    x[7] = np.nan
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(n) if i != 11], "id long, x array<double>")
    pool = [i for i in range(n) if i % 9]
    pos = {(int(a), int(b)) for a, b in rng.integers(0, n, (3000, 2))} | {(5, 7), (6, 11), (8, 8), (7, 1), (3, 2), (3, 4)}
    got = {r.source: (r.best_rank, r.n_reachable) for r in walks.best_ranks(spark.createDataFrame([(i,) for i in pool], "id long"), spark.createDataFrame(sorted(pos), "src long, tgt long"), vectors).collect()}
    want, members = {}, np.array([i for i in pool if i != 11])
    for s in {a for a, _ in pos} - {11}:
        own = {t for a, t in pos if a == s and t != s} & set(members.tolist())
        if own:
            score = np.nan_to_num(np.round(x[members] @ x[s], 9), nan=-np.inf)
            order = [i for _, i in sorted((-v, int(i)) for v, i in zip(score, members) if i != s)]
            want[s] = (min(order.index(t) for t in own) + 1, len(own))
    assert got == want


def test_quartiles(spark):
    rows = [(g, float(v)) for g in "ab" for v in range(9)]
    got = walks.quartiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
    assert {(r.g, r.v): r.stratum for r in got} == {(g, v): (v >= 2) + (v >= 4) + (v >= 6) for g, v in rows}
    assert G.numbered(spark.createDataFrame([], "id long")).count() == 0


def test_many_rows_of_few_columns_go_by_their_gram_matrix(spark, monkeypatch):
    a = np.random.default_rng(5).standard_normal((60, 6)) * np.linspace(3, 1, 6)
    matrix = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(60) for j in range(6)], "i long, j long, w double")
    met, times = [], walks._times
    monkeypatch.setattr(walks, "_times", lambda *x: met.append(1) or times(*x))
    rows, columns, got = walks.singular(matrix, 3, tol=1e-6)
    want = np.linalg.svd(a, compute_uv=False)[:3]
    assert np.allclose(got, want, atol=1e-9) and met == [1]  # the rows of the result alone
    y = np.array([r.x for r in columns.orderBy("id").collect()])
    assert np.allclose(a @ y, np.array([r.x for r in rows.orderBy("id").collect()]), atol=1e-9)


def test_ranks_deal_vectors_and_not_pairs_of_tiles(spark, monkeypatch):
    rows, columns = walks.dealt(84_000, 1_100_000, 46, 8)
    assert 84_000 * columns + 1_100_000 * rows < 2e7 and rows * columns * walks.MANY >= 0.5 * 84_000 * 1_100_000  # tiles of 1,024 were met 8.8e4 times, of 2,048 vectors
    assert walks.dealt(0, 0, 1, 8) == (1, 1)
    monkeypatch.setattr(walks, "HELD", 400)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((300, 3)), 1)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    pos = spark.createDataFrame([(i, (7 * i + 1) % 300) for i in range(0, 300, 2)], "src long, tgt long")
    found = walks.best_ranks(table.select("id"), pos, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    score = np.round(x @ x.T, 9)
    for r in found.collect():
        t = (7 * r.source + 1) % 300
        s = score[r.source]
        assert r.best_rank == 1 + sum((s[i], -i) > (s[t], -t) for i in range(300) if i != r.source)
    assert found.count() == 150
