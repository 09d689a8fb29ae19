"""Content vectors and spectral rankings against dense numpy, reports and audits against DuckDB, record conventions."""

import inspect
import json

import duckdb
import numpy as np
import pytest

from graphloom.operators.tables import children, shared_folder
from graphloom.plans import audits, floors, models, registry, statistics, stores
from graphloom.sources import packages as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer", "supplier", "documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: round(v, 6) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v
    return sorted(repr([value(r[k]) for k in order]) for r in rows)


NAMES = [*statistics.QUERIES, *audits.QUERIES, "graph_snapshot", "job_results", "run_documents", "per_source_arrays", "delimiter_lint", "box_overlaps", "parameter_counts", "encode_gcn", "encode_sage", "negatives_epoch"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, duck, name):
    home = next(m for m in (statistics, audits, stores, models) if name in m.QUERIES)
    got = home.QUERIES[name](spark, SF)
    want = duck.execute(home.ORACLES[name])
    assert _rows(got.columns, got.collect()) == _rows([c[0] for c in want.description], want.fetchall())


def _graph(duck):
    win = duck.execute(registry._duck("SELECT id, win FROM win ORDER BY id")).fetchall()
    return np.array([i for i, _ in win]), np.array([w for _, w in win]), duck.execute(registry._duck("SELECT src, tgt FROM edges")).fetchall()


def _mrr(ids, win, edges, x):
    x = {i: v for i, v in zip(ids.tolist(), x)}
    pool, w = [i for i, s in zip(ids.tolist(), win) if s != "test"], dict(zip(ids.tolist(), win))
    best = []
    for s in {a for a, _ in edges if w[a] == "test"}:
        own = {b for a, b in edges if a == s and w[b] != "test"}
        if own:
            order = [i for _, i in sorted((-round(float(x[s] @ x[i]), 9) + 0.0, i) for i in pool if i != s)]
            best.append(1 / (1 + min(order.index(b) for b in own)))
    return np.mean(best)


def test_vector_floor_is_that_of_a_dense_svd(spark, duck):
    ids, win, edges = _graph(duck)
    rows = duck.execute(floors.ORACLES["fitted_weights"].replace("round(x, 6)", "x")).fetchall()
    terms = {t: k for k, t in enumerate(sorted({t for _, t, _ in rows}))}
    m = np.zeros((len(ids), len(terms)))
    place = {i: k for k, i in enumerate(ids.tolist())}
    for i, t, x in rows:
        if i in place:
            m[place[i], terms[t]] = x
    fit = m[win == "fit"]
    used = fit.any(0)
    v = np.linalg.svd(fit[:, used], full_matrices=False)[2][: min(300, len(fit) - 1, used.sum() - 1)].T
    z = m[:, used] @ v
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-8)
    assert abs(models.vector_floor(spark, SF).first()["mrr"] - _mrr(ids, win, edges, z)) <= 0.006


def test_spectral_ranks_are_those_of_a_dense_svd(spark, duck):
    ids, win, edges = _graph(duck)
    w, place = dict(zip(ids.tolist(), win)), {i: k for k, i in enumerate(ids.tolist())}
    a = np.zeros((len(ids), len(ids)))
    for s, t in edges:
        if w[s] != "test":
            a[place[s], place[t]] = a[place[t], place[s]] = 1
    d = 1 / np.sqrt(np.maximum(a.sum(1), 1))
    u, s, _ = np.linalg.svd(d[:, None] * a * d)
    assert abs(models.rank_spectral(spark, SF).first()["mrr"] - _mrr(ids, win, edges, (u * s)[:, :128])) <= 0.02


def test_training_on_the_part_graph(spark):
    _, epoch, history, metrics = models.training(spark, SF, "sage_dir", 1, rule="last", hidden=4)
    assert [h["epoch"] for h in history] == [0, 1] and epoch == 1 and history[1]["loss"] > 0
    # an untrained encoder gives the content floor of the stage
    assert history[0]["val"] == pytest.approx(models.floor_of(spark, SF, "val"), abs=1e-9) and 0 < metrics.first()["mrr"] <= 1
    with pytest.raises(ValueError, match="rule"):
        models.training(spark, SF, "sage_dir", 1, rule="best", hidden=4)


def test_conventions_of_records(spark, tmp_path):
    record = {"name": "p", "description": "said", "keywords": ["k"], "readme": "r" * 700, "time": {"created": "2020-01-01", "modified": "2022-01-01", "2": "2021-01-01"}, "dist-tags": {"latest": "2"}, "versions": {"1": {"dependencies": {"a": "1", "node:fs": "1"}}, "2": {"dependencies": {"b": "1"}}}}
    (tmp_path / "p.json").write_text(json.dumps(record))
    raw = P.scan(spark, f"{tmp_path}/p.json", P.NPM)
    date = {w: str(P.npm_records(raw, when=w).first()["date"]) for w in ("created", "modified", "latest")}
    assert date == {"created": "2020-01-01", "modified": "2022-01-01", "latest": "2021-01-01"}
    assert P.npm_records(raw, deps="all").first()["deps"] == ["a", "b"] and P.npm_records(raw).first()["deps"] == ["b"]
    text = {n: P.npm_records(raw, readme=n).first()["text"] for n in (-1, 0, 500)}
    assert text == {-1: "said", 0: "p said k", 500: "p said k " + "r" * 500}
    lines = spark.createDataFrame([(x,) for x in ("# c", " g:a ", "g:a", "plain", "g:b", "")], "value string")
    assert sorted(r.name for r in P.seed_lines(lines, spark.createDataFrame([("g:b",)], "name string")).collect()) == ["g:a"]
    years = spark.createDataFrame([("9201001",), ("0301001",), ("8901001",)], "p string").select(P.id_year(P.F.col("p")).alias("y")).collect()
    assert [r.y for r in years] == [1992, 2003, 2089]


def test_crawl_of_a_long_chain(spark):
    deps = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(20)] + [("n3", "n3")], "name string, dep string").coalesce(1)
    seeds = spark.createDataFrame([("n0",)], "name string")
    got = {r.name: r.level for r in P.crawl(seeds, deps).collect()}
    assert got == {f"n{k}": k for k in range(21)}
    assert P.crawl(seeds, deps, target=4).count() == 4


def test_audit_deals_edges_twice_for_all_checks(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    edges = spark.createDataFrame([(1, 2, 0), (1, 2, 1), (1, 9, 1), (3, 3, 1), (2, 3, 0)], "src long, tgt long, since int")
    wins = [spark.createDataFrame(list(w), "id long, win string") for w in ({1: "fit", 2: "test", 3: "fit"}.items(), [(1, "fit"), (1, "fit"), (2, "test"), (3, "test")])]
    found = audits._edge_faults(nodes, edges, wins)
    got = {(r["at"], r["check"]): r["wrong"] for r in found.collect()}
    names = ("loops", "repeated edges", "targets without a node", "sources without a node", "fit edges into the test window")
    assert got == dict(zip(((v, n) for v in (0, 1) for n in names), (0, 0, 0, 0, 1, 1, 1, 1, 0, 4), strict=True))


def test_crawl_works_out_dependencies_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    deps = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(5)], "name string, dep string").mapInArrow(counted, "name string, dep string")
    assert P.crawl(spark.createDataFrame([("n0",)], "name string"), deps).count() == 6
    assert read.value == 5


@pytest.mark.parametrize("name", ["encode_gcn", "encode_sage"])
def test_messages_of_an_encoder_are_written_once(spark, monkeypatch, name):
    seen, encode = [], models.E.encode
    monkeypatch.setattr(models.E, "encode", lambda t, *more: seen.append(t.messages._jdf.queryExecution().executedPlan().toString()) or encode(t, *more))
    assert models.QUERIES[name](spark, SF).count() == 200
    assert "Exchange" not in seen[0] and "FileScan parquet" in seen[0]


@pytest.mark.parametrize("name", ["train_gcn_dir", "train_ragat_time"])
def test_trainings_have_all_their_epochs(monkeypatch, name):
    class Asked(Exception):
        pass

    def asked(*args, whole=inspect.signature(models.training), **more):
        of = whole.bind(*args, **more)
        of.apply_defaults()
        raise Asked(of.arguments["epochs"], of.arguments["patience"])

    monkeypatch.setattr(models, "training", asked)
    with pytest.raises(Asked) as said:
        models.QUERIES[name](None, SF)
    assert said.value.args == (100, 20)


def test_tables_of_a_validation_go_with_it(spark):
    at = f"{shared_folder(spark)}/graphloom"
    before = set(children(spark, at))
    models.training(spark, SF, "sage_dir", 1, hidden=4)
    left = {x.split("-")[0] for x in set(children(spark, at)) - before}
    assert "metrics" in left and not left & {"tops", "asks", "candidates", "tiles", "step"}
