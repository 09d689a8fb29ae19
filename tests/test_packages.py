"""Record scans, induction, tests over seeds and singular vectors against plain Python."""

import itertools
import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.functions import stats
from graphloom.operators import walks
from graphloom.sources import packages as P


def test_npm_records_of_odd_files(spark, tmp_path):
    files = {
        "normal": {"name": "normal", "description": "a  b", "keywords": ["k", "l"], "time": {"created": "2020-01-02T", "modified": "2021-01-02T"}, "dist-tags": {"latest": "2"}, "versions": {"1": {"dependencies": {"old": "1"}}, "2": {"dependencies": {"node:fs": "1", "@s/x": "1", "normal": "1"}}}},
        "untagged": {"name": "untagged", "keywords": "one two", "time": {"created": "2020-02-02", "1": "2020-03-01", "2": "2020-04-01", "3": "2020-05-01"}, "versions": {"1": {"dependencies": {"gone": "1"}}, "2": {"dependencies": {"normal": "1"}}, "3": {}}},
        "@s__x": {"name": "@s/x", "readme": "<b>x</b>" + "y" * 2000, "time": {"created": "2020-03-02"}, "dist-tags": {"latest": "1"}, "versions": {"1": {}}},
        "undated": {"name": "undated", "time": {}, "versions": {}},
    }
    for k, v in files.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    (tmp_path / "broken.json").write_text("{ not json")
    raw = P.scan(spark, str(tmp_path), P.NPM).cache()
    assert P.broken(raw).first()["broken"] == 1
    rows = {r["name"]: r for r in P.npm_records(raw).collect()}
    assert set(rows) == {"normal", "untagged", "@s/x"}
    assert rows["normal"]["deps"] == ["@s/x", "normal"] and rows["normal"]["text"] == "normal a b k l"
    assert rows["untagged"]["deps"] == ["normal"] and rows["untagged"]["text"] == "untagged one two"
    assert rows["@s/x"]["text"].startswith("@s/x <b>x</b>") and len(rows["@s/x"]["text"]) == 5 + P.README_CHARS
    assert {r["name"]: r["deps"] for r in P.npm_frontier(raw).where("name = 'untagged'").collect()} == {"untagged": []}
    nodes, edges = P.induce(P.npm_records(raw))
    name = {r["id"]: r["name"] for r in nodes.collect()}
    assert [name[k] for k in sorted(name)] == sorted(name.values()) and sorted(name) == [0, 1, 2]
    assert {(name[s], name[t]) for s, t in edges.collect()} == {("normal", "@s/x"), ("untagged", "normal")}


def test_names_are_numbered_in_order(spark):
    names = sorted({f"n{random.Random(i).randrange(10**6)}" for i in range(5000)})
    got = P.name_numbers(spark.createDataFrame([(x,) for x in names], "name string")).orderBy("id").collect()
    assert [r["name"] for r in got] == names and [r["id"] for r in got] == list(range(len(names)))


def test_p_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert abs(one(stats.t_two_sided(F.lit(2.0), F.lit(1))) - (1 - 2 / math.pi * math.atan(2))) < 1e-12
    assert abs(one(stats.t_two_sided(F.lit(2.0), F.lit(2))) - (1 - 2 / math.sqrt(6))) < 1e-12
    assert abs(one(stats.t_two_sided(F.lit(2.262157), F.lit(9))) - 0.05) < 1e-6
    for z in (0.0, 0.5, 1.96, 4.0):
        assert abs(one(stats.normal_two_sided(F.lit(z))) - math.erfc(z / math.sqrt(2))) < 1e-10
    for n, k in ((10, 9), (10, 5), (1, 0), (0, 0)):
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n) if n else 1.0
        assert abs(one(stats.sign_two_sided(F.lit(k), F.lit(n))) - want) < 1e-12


def test_signed_ranks_count_every_arrangement(spark):
    d = [1.0, -2.0, 3.5, 4.0, -0.5, 6.0, 7.0]
    r = stats.signed_ranks(spark.createDataFrame([(1, x) for x in d], "g int, diff double"), ["g"]).first()
    rank = {abs(x): i + 1 for i, x in enumerate(sorted(d, key=abs))}
    plus, most = sum(rank[abs(x)] for x in d if x > 0), len(d) * (len(d) + 1) / 2
    sums = [sum(k for k, on in zip(range(1, len(d) + 1), s, strict=True) if on) for s in itertools.product((0, 1), repeat=len(d))]
    assert (r["w_plus"], r["w_minus"]) == (plus, most - plus)
    assert abs(r["p"] - min(1, 2 * sum(x <= min(plus, most - plus) for x in sums) / len(sums))) < 1e-12


def test_singular_triplets(spark):
    a = np.random.default_rng(3).normal(size=(30, 12))
    rows, cols, s = walks.singular(spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(12)], "i long, j long, w double"), 3, rounds=6, spare=4)
    want = np.linalg.svd(a, compute_uv=False)[:3]
    assert np.allclose(s, want, atol=1e-6)
    u, v = (np.array([r["x"] for r in b.orderBy("id").collect()]) for b in (rows, cols))
    assert np.allclose(np.linalg.norm(u, axis=0), want, atol=1e-6) and np.allclose(a @ v, u, atol=1e-6)


def test_personal_rank(spark):
    edges = [(0, 1), (1, 2), (2, 0), (3, 1), (5, 6)]
    a = np.zeros((7, 7))
    for s, t in edges:
        a[s, t] = a[t, s] = 1
    p = a / np.maximum(a.sum(1, keepdims=True), 1)
    want = 0.85 * sum(0.15**k * np.linalg.matrix_power(p, k) for k in range(21))
    got = walks.personal_rank(spark.createDataFrame(edges, "src long, tgt long"), spark.createDataFrame([(0,), (4,)], "src long")).collect()
    assert {(r["src"], r["id"]) for r in got} == {(0, 0), (0, 1), (0, 2), (0, 3), (4, 4)}
    assert all(abs(r["score"] - want[r["src"], r["id"]]) < 1e-12 for r in got)


def test_induced_records_are_parsed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("a", "2020-01-01", ["b", "b", "a", "z", None]), ("b", "2020-01-02", ["a"]), ("c", "2020-01-03", [])]
    raw = spark.createDataFrame(rows, "name string, day string, deps array<string>").mapInArrow(counted, "name string, day string, deps array<string>")
    records = raw.selectExpr("name", "date(day) AS date", "date(day) AS date_latest", "name AS text", "deps")
    nodes, edges = P.induce(records)
    assert sorted(r.name for r in nodes.collect()) == ["a", "b", "c"] and sorted(map(tuple, edges.collect())) == [(0, 1), (1, 0)]
    assert read.value == 3
    nodes, edges = P.induce(records, min_edges=1)
    assert sorted(r.name for r in nodes.collect()) == ["a", "b"] and edges.count() == 2
