"""The graph core against plain Python, and queries against DuckDB on the smallest tables."""

import hashlib
import random

import duckdb
import pytest

from graphloom.operators import graph as G
from graphloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_split_rule_has_the_published_offsets():
    base = round(0.08 * 4959)
    assert [G.offset(4959, s)[1] - base for s in range(101, 111)] == [-7, -2, 3, 8, 13, 18, -18, -13, -8, -3]
    base = round(0.08 * 1664)
    assert [G.offset(1664, s)[1] - base for s in range(121, 131)] == [-11, -5, 1, 7, -12, -6, 0, 6, 12, -7]


def test_sparse_ranks_equal_the_definition(spark):
    rnd = random.Random(4)
    pool = list(range(0, 120, 2))
    scores = {(s, i): rnd.choice([1.0, 1.0, 2.5]) for s in (1, 3, 5) for i in rnd.sample(pool, 20)}
    positives = [(s, i) for s in (1, 3, 5, 7) for i in rnd.sample(pool, 15)]
    got = G.rank_sparse(spark.createDataFrame([(i,) for i in pool], "id long"), spark.createDataFrame(positives, "src long, tgt long"), spark.createDataFrame([(s, i, x) for (s, i), x in scores.items()], "src long, id long, score double")).collect()
    want = {(s, t): sorted(pool, key=lambda i: (-scores.get((s, i), 0), i)).index(t) + 1 for s, t in positives}
    assert {(r.src, r.tgt): r["rank"] for r in got} == want


@pytest.mark.parametrize("name", ["rank_degree", "rank_adamic_adar", "per_source", "descriptors_raw", "audit_checks", "contrasts", "bootstrap_ci", "prerelease_filter", "bfs_levels"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events", "documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    x = c.execute(registry.ORACLES[name])
    at = [[d[0] for d in x.description].index(k) for k in cols]
    assert sorted(repr(tuple(r[k] for k in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in x.fetchall())


def test_best_sparse_adds_rows_and_equals_rank_sparse(spark):
    """Sums of several rows, ties, positives without a score or out of the pool, a score of 0."""
    pool = [i for i in range(50) if i % 6]
    paths = [(s, (s * 5 + k * 7) % 50, float(k % 3), 2.0) for s in range(8) for k in range(20) if (s * 5 + k * 7) % 50 in pool and s != 3]
    scores = {}
    for s, i, w, by in paths:
        scores[s, i] = scores.get((s, i), 0.0) + w / by
    positives = sorted({(s, (s * 11 + k * 13) % 50) for s in range(9) for k in range(1 + s % 4)})
    ids, pos = spark.createDataFrame([(i,) for i in pool], "id long"), spark.createDataFrame(positives, "src long, tgt long")
    want = G.per_source(G.rank_sparse(ids, pos, spark.createDataFrame([(s, i, x) for (s, i), x in scores.items() if x > 0], "src long, id long, score double")))
    got = G.best_sparse(ids, pos, spark.createDataFrame(paths, "src long, id long, w double, by double"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("source", "best_rank", "rr", "n_reachable").collect()))


def test_best_sparse_deals_pairs_once(spark):
    """Pairs of a source and a candidate go through one exchange, whatever else is asked of them."""
    ids, pos = spark.range(40), spark.range(9).selectExpr("id AS src", "id + 3 AS tgt")
    plan = G.best_sparse(ids, pos, spark.range(99).selectExpr("id % 9 AS src", "id % 40 AS id", "1.0D AS w", "1.0D AS by"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 99") == 1 and "src" in plan


def test_negatives_of_hubs_equal_the_arrays(spark):
    """Draws as rows and draws as arrays give the same, for sources with few and with many edges."""
    edges = spark.createDataFrame(sorted({(s, (s * 7 + k * 11) % 400) for s in range(0, 300, 9) for k in range(1 + s % 14)}), "src long, tgt long")
    win = spark.createDataFrame([(i, i + 1, "fit" if i < 300 else "test") for i in range(400)], "id long, rn long, win string")
    arrays, rows = (sorted(map(tuple, G.negatives(edges, win, hub=hub).collect())) for hub in (G.HUB, 0))
    assert arrays == rows and len(rows) > 300


def test_descriptors_work_raw_columns_out_once(spark):
    """The standardised descriptors read kept raw ones: no join is left in their plan but that with one row."""
    plan = registry.QUERIES["descriptors_z"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "lineitem" not in plan


def test_two_hop_deals_as_many_tasks_as_its_paths_need(spark):
    edges = spark.createDataFrame([(a, 100 + b) for a in range(30) for b in range(4)] + [(100 + b, c) for b in range(4) for c in range(30)], "src long, tgt long")
    got = G.two_hop(edges, most=100)
    assert "hashpartitioning(src" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 41)" in plan
    assert {(r.src, r.tgt): r.paths for r in got.collect()} == {(a, c): 4 for a in range(30) for c in range(30)} | {(100 + b, 100 + d): 30 for b in range(4) for d in range(4)}


def test_negatives_are_dealt_to_as_many_tasks_as_their_draws_need(spark, monkeypatch):
    """Sources of few and of many edges against the definition, one number at a time."""
    monkeypatch.setattr(G, "DRAWS", 400)
    edges = sorted({(s, (s * 7 + k * 11) % 400) for s in range(0, 300, 9) for k in range(1 + s % 14)})
    win = [(i, i + 1, "fit" if i < 300 else "test") for i in range(400)]
    got = G.negatives(spark.createDataFrame(edges, "src long, tgt long"), spark.createDataFrame(win, "id long, rn long, win string"), ":5:")
    assert f", {-(-10 * len(edges) // 400)})" in got._jdf.queryExecution().executedPlan().toString()
    want = set()
    for s in {a for a, _ in edges}:
        own = [b for a, b in edges if a == s]
        h = lambda j: int(hashlib.md5(f"{s}:5:{j}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        places = (h(j) % 300 + 1 for j in range(1, 40 * len(own) + 1)) if 40 * len(own) < 300 else sorted(range(1, 301), key=lambda j: (h(j), j))
        want |= {(s, i - 1) for i in [i for i in dict.fromkeys(places) if i - 1 not in own][: 10 * len(own)]}
    assert sorted(map(tuple, got.collect())) == sorted(want)
