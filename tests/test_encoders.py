"""Encoders against dense numpy, gradients against finite differences, softmax at a hub."""

import numpy as np
import pytest

from graphloom.operators import encoders as E
from graphloom.operators.tables import Scratch

N, DIM, HIDDEN = 30, 5, 3
MODELS = ["gcn_dir", "sage_dir", "gatv2_dir", "ragat_time", "ragat_asym"]


def graph(seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((N, DIM))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, N - 2, (70, 2)) if a != b} | {(k, 0) for k in range(1, N - 2)})
    return x, rng.standard_normal((N, 13)), edges, {e: float(t) for e, t in zip(edges, rng.random(len(edges)))}


def drawn(s, seed=7):
    """Parameters without zeros, so that every gradient shows."""
    rng = np.random.default_rng(seed)
    return {n: rng.standard_normal(size) * 0.5 for n, size in E.sizes(s).items()}


def dense(s, p, x, desc, edges, times):
    """The definition, with full matrices."""
    n = len(x)
    h, k = s.hidden, s.heads
    adj = {"in": np.zeros((n, n)), "out": np.zeros((n, n))}
    mean = {"in": np.zeros(n), "out": np.zeros(n)}
    for a, b in edges:
        adj["in"][b, a] = adj["out"][a, b] = 1
    for v, at in (("in", 1), ("out", 0)):
        for i in range(n):
            own = [t for e, t in times.items() if e[at] == i]
            mean[v][i] = np.mean(own) if own else 0

    def layer(L, y):
        parts = []
        for v in ("in", "out"):
            at, m = f"{L}.{v}", adj[v]
            if s.conv == "gcn":
                m = m + np.eye(n)
                d = 1 / np.sqrt(m.sum(1))
                u = (d[:, None] * m * d) @ y @ p[f"w{at}"]
            elif s.conv == "sage":
                u = m / np.maximum(m.sum(1, keepdims=True), 1) @ y @ p[f"w{at}"] + y @ p[f"root{at}"]
            else:
                m, u = m + np.eye(n), 0
                for q in range(k):
                    cols = slice(q * h, (q + 1) * h)
                    if s.conv == "gat":
                        left = right = y @ p[f"w{at}"][:, cols]
                        e = (left @ p[f"from{at}"][q])[None, :] + (right @ p[f"to{at}"][q])[:, None]
                        e = np.where(e > 0, e, 0.2 * e)
                    else:
                        left, right = y @ p[f"wl{at}"][:, cols] + p[f"bl{at}"][cols], y @ p[f"wr{at}"][:, cols] + p[f"br{at}"][cols]
                        e = left[None] + right[:, None]
                        e = np.where(e > 0, e, 0.2 * e) @ p[f"att{at}"][q]
                    e = np.where(m > 0, e, -np.inf)
                    a = np.exp(e - e.max(1, keepdims=True))
                    u = u + a / a.sum(1, keepdims=True) @ left / k
            u = u + p[f"b{at}"]
            if s.timed:
                u = u + mean[v][:, None] * p[f"time{L}"]
            if s.gated:
                u = u * (1 + np.tanh(desc @ p[f"gate{at}"] + p[f"gate0{at}"]))[:, None]
            parts.append(u)
        return np.hstack(parts) @ p[f"mix{L}"] + p[f"mix0{L}"]

    o = layer("1", x @ p["down"])
    e = np.where(o > 0, o, np.exp(np.minimum(o, 0)) - 1)
    y = (e - e.mean(1, keepdims=True)) / np.sqrt(e.var(1, keepdims=True) + 1e-5) * p["gain"] + p["shift"]
    z = x + layer("2", y) @ p["up"]
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def loss_of(s, p, z, pairs):
    u, v = z[[a for a, _, _ in pairs]], z[[b for _, b, _ in pairs]]
    x = np.exp(p["scale"][0]) * (u * v).sum(1)
    if s.decoder:
        a = np.hstack([u, v, u * v, u - v]) @ p["dec1"] + p["dec10"]
        x = x + np.where(a > 0, a, np.exp(np.minimum(a, 0)) - 1) @ p["dec2"] + p["dec20"][0]
    y = np.array([c for _, _, c in pairs])
    return float((np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0) - y * x).mean())


def spread(spark, s, x, desc, edges, times):
    rows = [(k, x[k].tolist(), desc[k].tolist()) for k in range(len(x))]
    nodes = spark.createDataFrame(rows, "id long, x array<double>, desc array<double>").repartition(3).persist()
    e = spark.createDataFrame([(a, b, times[a, b]) for a, b in edges], "src long, tgt long, time double").repartition(3).persist()
    return E.tables(nodes, e.select("src", "tgt"), s, len(x), e)


@pytest.mark.parametrize("model", MODELS)
def test_encoding_and_gradient(spark, model):
    s = E.shape(model, DIM, HIDDEN, heads=2, **({"decoder": 4} if model.endswith("asym") else {}))
    g, p = graph(), drawn(s)
    t = spread(spark, s, *g)
    want = dense(s, p, *g)
    with Scratch(spark) as scratch:
        got = {r.id: r.x for r in E.encode(t, s, p, scratch).collect()}
    assert np.allclose([got[k] for k in range(N)], want, atol=1e-9)
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b), float(y)) for a, b, y in zip(rng.integers(0, N, 40), rng.integers(0, N, 40), rng.integers(0, 2, 40))]
    loss, grad = E.gradient(t, s, p, spark.createDataFrame(pairs, "src long, tgt long, y double"))
    assert loss == pytest.approx(loss_of(s, p, want, pairs), abs=1e-9)
    x, numeric = E.flat(p, s), np.zeros(E.parameter_count(s))
    for k in range(len(x)):
        for sign in (1, -1):
            y = x.copy()
            y[k] += sign * 1e-5
            q = E.unflat(y, s)
            numeric[k] += sign * loss_of(s, q, dense(s, q, *g), pairs) / 2e-5
    assert np.allclose(grad, numeric, atol=1e-6)


@pytest.mark.parametrize("model", ["gcn_dir", "ragat_time"])
def test_untrained_gives_content_back(spark, model):
    s = E.shape(model, DIM, HIDDEN)
    g = graph()
    with Scratch(spark) as scratch:
        got = {r.id: r.x for r in E.encode(spread(spark, s, *g), s, E.initial(s, 5), scratch).collect()}
    assert np.allclose([got[k] for k in range(N)], g[0], atol=1e-12)


def test_softmax_at_a_hub(spark):
    """A target of 100,000 in-edges whose scores differ by hundreds, in many tasks."""
    s = E.shape("gat_dir", 2, 2, heads=2)
    n = 100_001
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, 2)) * 300
    p = drawn(s) | {"down": np.eye(2)}
    nodes = spark.createDataFrame(spark.sparkContext.parallelize([(k, x[k].tolist()) for k in range(n)], 8), "id long, x array<double>")
    edges = spark.range(1, n).selectExpr("id AS src", "0L AS tgt")
    t = E.tables(nodes, edges, s, n)
    with Scratch(spark) as scratch:
        b = spark.sparkContext.broadcast(E.flat(p, s))
        first = scratch.keep(E._node_pass(t, None, E.begin, s, b, 0, {}))
        rows = scratch.keep(E._edge_pass(t, first, "1", "l", "r", E._forward, s, b, 0))
        parts = rows.where("id = 0 and what = 'a1.in'").collect()
    assert len(parts) > 3
    _, triple = E._merged(np.zeros(len(parts), int), np.array([r.v for r in parts]), 2)
    for q in range(2):
        w = p["w1.in"][:, 2 * q : 2 * q + 2]
        e = (x @ w @ p["from1.in"][q]) + (x[0] @ w @ p["to1.in"][q])
        e = np.where(e > 0, e, 0.2 * e)
        a = np.exp(e - e.max())
        assert np.allclose(triple[0, 4 + 2 * q : 6 + 2 * q] / triple[0, 2 + q], a @ x / a.sum(), rtol=1e-9)


def test_parameter_counts():
    """Golden values: published numbers of parameters of each model and width."""
    want = {("ragat_sym", 64): 122937, ("gat_time", 64): 123009, ("gcn_dir", 128): 208897, ("sage_dir", 128): 274433, ("gatv2_dir", 128): 673793, ("gatv2_dir", 64): 189441}
    for (model, hidden), n in want.items():
        assert E.parameter_count(E.shape(model, 300, hidden)) == n
    at = {m: E.parameter_count(E.shape(m, 300, 128)) for m in E.MODELS}
    assert (at["gat_dir"], at["ragat_sym"], at["gat_time"], at["ragat_time"]) == (409601, 409657, 409857, 409913)
    assert E.shape("rcgat_sym", 300, 64) == E.shape("ragat_sym", 300, 64)


def test_training_lowers_the_loss_and_keeps_by_rule(spark):
    s = E.shape("gcn_dir", DIM, HIDDEN, dropout=0.1)
    g = graph()
    t = spread(spark, s, *g)
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in g[2]] + [(a, (a * 7 + b) % N, 0.0) for a, b in g[2]], "src long, tgt long, y double")
    seen = []

    def value(p):
        seen.append(float(p["scale"][0]))
        return [0.3, 0.2, 0.5, 0.4][min(len(seen) - 1, 3)]

    p, epoch, history = E.train(t, s, lambda e: pairs, 1, 3, value, every=1, patience=5, rate=0.05)
    assert epoch == 2 and [h["val"] for h in history] == [0.3, 0.2, 0.5, 0.4]
    assert history[3]["loss"] < history[1]["loss"] and float(p["scale"][0]) == seen[2]


def test_a_tile_of_pairs_gives_one_row_of_gradients_an_end(spark, monkeypatch):
    """100,000 pairs of 30 nodes: rows of gradients follow the nodes and not the pairs, and tiles of any number give the same."""
    s = E.shape("gcn_dir", DIM, HIDDEN)
    g, p = graph(), drawn(s)
    t = spread(spark, s, *g)
    pairs = spark.range(100_000).selectExpr(f"id % {N} AS src", "id * 7 % 31 AS tgt", "cast(id % 2 AS double) AS y").persist()  # 30 has no vector
    kept, rows = Scratch.keep, []
    monkeypatch.setattr(Scratch, "keep", lambda self, df, tag="step": (out := kept(self, df, tag), rows.append(out.where("what = 'dz'").count() if "what" in out.columns else 0))[0])
    one = E.gradient(t, s, p, pairs)
    assert N < max(rows) <= 2 * N
    monkeypatch.setattr(E, "FEW", 100)
    rows.clear()
    many = E.gradient(t, s, p, pairs)
    assert max(rows) <= 2 * 4 * N
    assert many[0] == pytest.approx(one[0], rel=1e-12) and np.allclose(many[1], one[1], atol=1e-12)


@pytest.mark.parametrize("model", ["gcn_dir", "ragat_time"])
def test_a_tile_of_messages_gives_one_sum_a_node(spark, monkeypatch, model):
    """40,000 edges of 400 nodes in one tile a view; tiles of any number and joins give the same."""
    s = E.shape(model, 2, 2, heads=2, dropout=0.2)
    nodes = spark.range(400).selectExpr("id", "array(sin(id), cos(id)) AS x", "array_repeat(id / 400.0D, 13) AS desc").repartition(3).persist()
    edges = spark.range(40_000).selectExpr("id % 400 AS src", "(id % 400 + id div 400 * 3 + 1) % 400 AS tgt").where("src <> tgt").distinct().persist()
    t, p = E.tables(nodes, edges, s, 400), drawn(s)
    pairs = edges.where("src % 50 = 0").selectExpr("src", "tgt", "cast(tgt % 2 AS double) AS y").persist()
    with Scratch(spark) as scratch:
        b = spark.sparkContext.broadcast(E.flat(p, s))
        first = scratch.keep(E._node_pass(t, None, E.begin, s, b, 0, {}))
        assert E._edge_pass(t, first, "1", "l", "r" if s.attends else "", E._forward, s, b, 7).count() == 2 * 400
    one = E.gradient(t, s, p, pairs, 7)
    monkeypatch.setattr(E, "BLOCK", 100)
    many = E.gradient(E.tables(nodes, edges, s, 400), s, p, pairs, 7)
    monkeypatch.setattr(E, "TILED", 0)
    for other in (many, E.gradient(t, s, p, pairs, 7)):
        assert other[0] == pytest.approx(one[0], rel=1e-12) and np.allclose(other[1], one[1], atol=1e-12)
