"""The learned scorer: gradients by differences, features and ranks against dense numpy."""

import numpy as np
import pytest

from graphloom.operators import pairs as L


def test_gradient_of_the_margin_loss():
    rng = np.random.default_rng(1)
    w = L.initial(4, 2)
    pos, neg = rng.standard_normal((5, 4)), rng.standard_normal((5, 3, 4))
    _, g = L.margin_loss(w, pos, neg)
    for k in range(len(w)):
        for at in list(np.ndindex(w[k].shape))[:7]:
            up, down = ([x.copy() for x in w] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[k][at] == pytest.approx((L.margin_loss(up, pos, neg)[0] - L.margin_loss(down, pos, neg)[0]) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("full", [True, False])
def test_features_ranks_and_fit(spark, full):
    rng = np.random.default_rng(3)
    n, e = 60, set()
    while len(e) < 150:
        a, b = map(int, rng.integers(0, n, 2))
        if a != b:
            e.add((a, b))
    A = np.zeros((n, n))
    for a, b in e:
        A[a, b] = A[b, a] = 1
    deg = A.sum(1)
    z = rng.standard_normal((n, 3))
    ends = np.column_stack([z, np.log1p(deg)])
    w = np.array([1 / np.log(max(d, 2)) if d > 1 else 0 for d in deg])
    inv = np.divide(1, deg, out=np.zeros(n), where=deg > 0)
    two = (A * inv[:, None]) @ (A * inv[:, None])
    near = np.stack([A, A @ A, w[:, None] * A, inv[:, None] * A, 0.15 * A * inv[:, None] + 0.15**2 * two], -1)
    edges = spark.createDataFrame(sorted(e), "src long, tgt long")
    rows = {(r.src, r.tgt): r.near for r in L.near_pairs(edges, edges, ["src"]).collect()}
    for a in {a for a, _ in e}:
        for b in range(n):
            if a != b:
                assert np.allclose(rows.get((a, b), np.zeros(5)), near[a, b])
    asked = [(0, b) for b in range(1, n)]
    got = {(r.src, r.tgt): r.near for r in L.near_pairs(edges, spark.createDataFrame(asked, "src long, tgt long"), ["src", "tgt"]).collect()}
    assert all(np.allclose(got.get(p, np.zeros(5)), near[p]) for p in asked)

    table = spark.createDataFrame([(k, ends[k].tolist()) for k in range(n)], "id long, x array<double>").persist()
    numbers = spark.createDataFrame([(k, k + 1) for k in range(n)], "id long, at long")
    scorer, losses = L.fit(edges, table, numbers, full, seed=4, epochs=6, batch=100)
    assert losses[-1] < losses[0]
    pool = [k for k in range(n) if k % 5]
    pos = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (40, 2))})
    got = {r.source: (r.best_rank, r.n_reachable) for r in L.best_ranks(scorer, edges, table, spark.createDataFrame([(k,) for k in pool], "id long"), spark.createDataFrame(pos, "src long, tgt long")).collect()}
    want = {}
    for s in {a for a, _ in pos}:
        own = {b for a, b in pos if a == s and b != s and b in pool}
        if own:
            c = [k for k in pool if k != s]
            x = np.round(scorer.near(near[s, c], np.tile(ends[s], (len(c), 1)), ends[c]), 9)
            order = [k for _, k in sorted(zip(-x, c))]
            want[s] = (min(order.index(t) for t in own) + 1, len(own))
    assert got == want


def test_training_takes_the_steps_of_batches_by_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    from graphloom.operators.encoders import Adam

    rng = np.random.default_rng(1)
    groups = [(rng.integers(0, 3, 3).astype(float).tolist(), rng.integers(0, 3, (int(k), 3)).astype(float).tolist(), int(v)) for k, v in zip(rng.integers(1, 5, 1500), rng.integers(0, 1 << 30, 1500))]
    mean, dev, w = np.ones(3), np.full(3, 0.7), L.initial(3, 2)
    read, gradient = [], L._gradient
    monkeypatch.setattr(L, "_gradient", lambda some, *more: read.append(some) or gradient(some, *more))
    got, losses = L.trained(spark.createDataFrame(groups, "pos array<double>, neg array<array<double>>, u long"), w, mean, dev, 3, 4, Adam(1e-2, 1e-5))
    x, adam, want = w, Adam(1e-2, 1e-5), []
    table = spark.createDataFrame([g[2:] for g in groups], "u long")
    turns = [[r.k for r in table.select(F.pmod(F.xxhash64(F.lit(e), "u"), F.lit(4)).alias("k")).collect()] for e in range(3)]
    for turn in turns:
        sums = 0.0
        for k in range(4):
            loss, pairs, grad = 0.0, 0, 0.0
            for pos, neg, _ in (g for g, t in zip(groups, turn) if t == k):
                one, g = L.margin_loss(x, (np.array([pos]) - mean) / dev, (np.array([neg]) - mean) / dev)
                loss, pairs, grad = loss + one, pairs + len(neg), grad + L._flat(g)
            sums += loss
            x = L._like(adam.next(L._flat(x), grad / pairs), x)
        want.append(sums)
    assert len(read) == 12 and "PartitionFilters: [isnotnull(k" in read[5]._jdf.queryExecution().toString()
    assert np.allclose(losses, want) and np.allclose(L._flat(got), L._flat(x), atol=1e-9)


@pytest.mark.parametrize("full", [True, False])
def test_far_pairs_by_terms_equal_the_network(full):
    rng = np.random.default_rng(7)
    x, y = (np.hstack([rng.integers(0, 2, (n, 3 * full)), rng.integers(0, 4, (n, 1))]).astype(float) for n in (300, 280))
    width = 8 if full else 3
    s = L.Scorer(L.initial(width, 1), rng.standard_normal(width), rng.random(width) + 0.5, full)
    want = [s.near(np.zeros((len(y), 5)), np.tile(r, (len(y), 1)), y) for r in x]
    assert np.allclose(s.grid(x, y, False), want, atol=2e-9)
