"""Parts of a graph: walks and vectors within them against steps over the edges, and graphs over the bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import parts as X
from graphloom.operators import spectral as S
from graphloom.operators import walks
from graphloom.operators.tables import Scratch


def _edges(spark, copies=3, n=40, m=90, seed=5):
    rng = np.random.default_rng(seed)
    e = {(int(a) + 1000 * k, int(b) + 1000 * k) for k in range(copies) for a, b in rng.integers(0, n, (m, 2)) if a != b}
    e |= {(k, k + 1) for k in range(5000, 5030)}  # a chain, whose labels take more rounds
    e |= {(7000, k) for k in range(7001, 7050)}  # a star
    return spark.createDataFrame(sorted(e), "src long, tgt long").persist()


def test_parts_hold_every_entry_once(spark):
    edges = _edges(spark)
    both = {(r.src, r.tgt) for r in G.symmetric(edges).collect()}
    with Scratch(spark) as scratch:
        members, parts = X.packed(edges, scratch)
        assert {r.id for r in members.collect()} == {a for a, _ in both}
        got = []
        for r in parts.collect():
            a = X.Adjacency(np.array(r.deg), np.array(r.idx))
            dense = a.times(np.eye(len(r.ids)))
            got += [(r.ids[i], r.ids[j]) for i, j in zip(*np.nonzero(dense))]
            assert set(np.unique(dense)) <= {0.0, 1.0}
        assert len(got) == len(both) and set(got) == both
        assert X.packed(edges, scratch, nodes=20) is None and X.packed(edges, scratch, entries=50) is None


def test_walks_within_parts_equal_steps_over_edges(spark, monkeypatch):
    edges = _edges(spark)
    sources = spark.createDataFrame([(x,) for x in (0, 1, 2, 1001, 2002, 5003, 7000, 7001, 9999)], "src long")
    monkeypatch.setattr(walks, "WALKS", 2)
    got = {(r.src, r.id): r.score for r in walks.personal_rank(edges, sources).collect()}
    want = {(r.src, r.id): r.score for r in walks.stepped(edges, sources).collect()}
    assert set(got) == set(want) and got[9999, 9999] == 0.85
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    monkeypatch.setattr(X, "NODES", 20)  # a part over the bounds: over the edges, and nothing is lost
    assert {(r.src, r.id): r.score for r in walks.personal_rank(edges, sources).collect()} == pytest.approx(want, rel=1e-12)


def test_ranks_by_walks_equal_those_of_rows(spark):
    edges = _edges(spark)
    ids = sorted({x for r in edges.collect() for x in (r.src, r.tgt)} | {9998, 9999})
    pool = spark.createDataFrame([(x,) for x in ids if x % 3], "id long")
    rng = np.random.default_rng(2)
    pos = {(int(a), int(b)) for a, b in rng.choice(ids, (120, 2)) if a != b and not a % 3} | {(9999, 1), (0, 9998), (0, 1)}
    positives = spark.createDataFrame(sorted(pos), "src long, tgt long")
    walk = walks.stepped(edges, positives.select("src").distinct().join(G.symmetric(edges).select("src").distinct(), "src", "left_semi"))
    scores = walk.join(pool, "id", "left_semi").select("src", "id", F.round(F.col("score") + 1.3e-12, 9).alias("w"), F.lit(1.0).alias("by")).where("id <> src")
    want = sorted(map(tuple, G.best_sparse(pool, positives, scores).collect()))
    assert sorted(map(tuple, walks.walk_ranks(pool, positives, edges).collect())) == want and len(want) > 15


def test_spectral_vectors_are_those_of_a_dense_matrix(spark, monkeypatch):
    edges = _edges(spark, copies=2)
    both = [(r.src, r.tgt) for r in G.symmetric(edges).collect()]
    ids = sorted({a for a, _ in both})
    m = np.zeros((len(ids), len(ids)))
    for a, b in both:
        m[ids.index(a), ids.index(b)] = 1
    m /= np.sqrt(np.outer(m.sum(1), m.sum(1)))
    monkeypatch.setattr(S, "SLICE", 16)
    rows, values = S.spectral(edges, 18, tol=1e-4)
    assert np.allclose(values, np.linalg.svd(m, compute_uv=False)[:18], atol=1e-3) and len(values) == 18
    found = {r.id: r.x for r in rows.collect()}
    assert sorted(found) == ids
    x = np.array([found[i] for i in ids])
    assert np.allclose(x.T @ x, np.diag(np.square(values)), atol=1e-3)
    assert np.allclose(m @ m @ x, x * np.square(values), atol=1e-3)
    monkeypatch.setattr(X, "NODES", 20)  # over the bounds: the whole job by joins
    monkeypatch.setattr(walks, "singular", lambda matrix, k, *more, **others: (matrix, None, [matrix.count()]))
    assert S.spectral(edges, 5)[1] == [len(both)]


def test_a_start_with_small_values_keeps_its_rank():
    values, x = np.linspace(0.0366, 0.0317, 160), np.ones((1, 1))  # of a hashed start in 120,000 nodes, whose largest value is 1
    step = S._damped(values, 8)
    for v in (1.0, 0.9, 0.5):
        assert abs(step(lambda y: y * np.sqrt(v), [x, v * x])[0][0, 0]) <= 1e4 * max(abs(step(lambda y: y * np.sqrt(w), [x, w * x])[0][0, 0]) for w in values)


def test_a_part_goes_to_as_many_tasks_as_keep_the_cores_at_work(spark, monkeypatch):
    monkeypatch.setattr(walks, "WALKS", 1)
    edges = spark.createDataFrame([(k, (k + 1) % 100) for k in range(100)], "src long, tgt long")
    found = walks.personal_rank(edges, edges.select("src"))
    each = -(-100 // (4 * spark.sparkContext.defaultParallelism))
    assert each > 1 and f"/ cast({each} as double)" in found._jdf.queryExecution().analyzed().toString()  # a copy for each source before
    assert found.select("src").distinct().count() == 100
