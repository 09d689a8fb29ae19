"""Queries do the whole job: every source, step, term and resample."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.plans import registry, scans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _by_name(duck, sql, cols):
    return sorted(map(repr, duck.execute(f"SELECT {', '.join(cols)} FROM ({sql}) q").fetchall()))


def _graph(duck, body):
    return duck.execute(registry._duck(body)).fetchall()


def test_two_hop_and_negatives_have_every_source(spark, duck):
    edges = _graph(duck, "SELECT src, tgt FROM edges")
    got = registry.QUERIES["two_hop"](spark, SF).collect()
    out = {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
    want = {}
    for s, t in edges:
        for u in out.get(t, ()):
            want[s, u] = want.get((s, u), 0) + 1
    assert {(r.src, r.tgt): r.paths for r in got} == want
    fit = {x for (x,) in _graph(duck, "SELECT id FROM win WHERE win = 'fit'")}
    drawn = registry.QUERIES["negatives"](spark, SF).collect()
    mine = {}
    for r in drawn:
        mine.setdefault(r.src, []).append(r.id)
    assert set(mine) == {s for s in out if s in fit and fit - out[s]}
    assert all(len(set(x)) == len(x) == min(10 * len(out[s]), len(fit - out[s])) and set(x) <= fit - out[s] for s, x in mine.items())
    assert sorted(map(repr, ((r.src, r.id) for r in drawn))) == _by_name(duck, registry.ORACLES["negatives"], ["src", "id"])


def test_walks_and_singular_values_are_whole(spark, duck):
    edges = np.array(_graph(duck, "SELECT src, tgt FROM edges"))
    ids = np.unique(edges)
    a = np.zeros((len(ids), len(ids)))
    s, t = np.searchsorted(ids, edges).T
    a[s, t] = a[t, s] = 1
    p = a / a.sum(1, keepdims=True)
    want = 0.85 * sum(0.15**k * np.linalg.matrix_power(p, k) for k in range(21))
    sources = {x for (x,) in _graph(duck, "SELECT DISTINCT e.src FROM edges e JOIN win w ON w.id = e.src WHERE w.win = 'test'")}
    got = {(r.src, r.id): r.score for r in scans.personal_rank(spark, SF).collect()}
    at = {int(x): k for k, x in enumerate(ids)}
    assert set(got) == {(s, int(i)) for s in sources for i in ids if want[at[s], at[int(i)]] > 0}
    assert all(abs(x - want[at[s], at[i]]) < 2e-9 for (s, i), x in got.items())
    d = a.sum(1)
    values = np.linalg.svd(a / np.sqrt(np.outer(d, d)), compute_uv=False)[:128]
    assert np.allclose([r.value for r in scans.singular_values(spark, SF).orderBy("k").collect()], values, atol=6e-4)


def test_bootstrap_has_ten_thousand_hashed_resamples(spark, duck):
    x = np.array([r[0] for r in duck.execute(registry._duck(registry.RUNS + " SELECT diff FROM delta ORDER BY dataset, model, seed")).fetchall()])
    at = [[int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:15], 16) % len(x) for i in range(len(x))] for b in range(1, 10_001)]
    want = np.percentile(x[np.array(at)].mean(axis=1), [2.5, 97.5])
    got = registry.QUERIES["bootstrap_ci"](spark, SF).first()
    assert np.allclose([got.low, got.high], want, atol=2e-9)


def test_descriptors_have_cosines_and_fit_edges_only(spark, duck):
    fit = _graph(duck, "SELECT e.src, e.tgt FROM edges e JOIN win w ON w.id = e.src WHERE w.win = 'fit'")
    words = {i: Counter(re.findall(r"[a-z][a-z0-9_+#.-]*", t.lower())) for i, t in duck.execute("SELECT p_partkey, concat(p_name, ' ', p_brand, ' ', p_type) FROM part").fetchall()}
    df = Counter(w for c in words.values() for w in c)
    vector = {i: {w: (1 + math.log(n)) * (math.log((1 + len(words)) / (1 + df[w])) + 1) for w, n in c.items()} for i, c in words.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vector.items()}
    cos = lambda a, b: sum(x * vector[b].get(w, 0) for w, x in vector[a].items()) / norm[a] / norm[b]
    rows = registry.QUERIES["descriptors_raw"](spark, SF).collect()
    assert len(rows[0]) == 14
    for r in rows:
        into, out = ([cos(s, t) for s, t in fit if (t, s)[k] == r.id] for k in (0, 1))
        assert abs(r.in_degree - math.log(1 + len(into))) < 2e-6 and abs(r.out_degree - math.log(1 + len(out))) < 2e-6
        assert abs(r.cos_in - sum(into) / max(len(into), 1)) < 2e-6 and abs(r.cos_out - sum(out) / max(len(out), 1)) < 2e-6
