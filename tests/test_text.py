"""Recipes and content rankings by hand, and against a loop over sources and candidates."""

import math
import random
import re
from collections import Counter

from graphloom.operators import graph as G
from graphloom.operators import text as T


def test_letters_and_stop_words(spark):
    rows = spark.createDataFrame([(1, "a  Bcd"), (2, None), (3, ""), (4, "the the Cat-fish")], "id long, text string")
    letters = {(r.id, r.term): r.k for r in T.terms(rows, T.Recipe(letters=True)).collect()}
    assert {t for i, t in letters if i == 1} == {" a ", " bc", "bcd", "cd ", " bcd", "bcd ", " bcd "} and not {i for i, _ in letters} & {2, 3}
    assert {(r.id, r.term, r.k) for r in T.terms(rows, T.Recipe()).collect()} == {(1, "bcd", 1), (4, "cat-fish", 1)}


def test_unknown_terms_go_before_the_norm(spark):
    rows = spark.createDataFrame([(1, "x y"), (2, "x"), (3, "x z z")], "id long, text string")
    got = {(r.id, r.term): r.x for r in T.tfidf(rows, spark.createDataFrame([(1,), (2,)], "id long"), T.Recipe()).collect()}
    y = math.log(3 / 2) + 1
    assert set(got) == {(1, "x"), (1, "y"), (2, "x"), (3, "x")} and got[3, "x"] == 1.0
    assert abs(got[1, "y"] - y / math.hypot(1, y)) < 1e-12


def test_ranks_equal_a_loop_where_sources_are_candidates(spark):
    rng = random.Random(5)
    ids = list(range(30))
    scores = {(s, c): float(rng.randint(1, 3)) for s in range(6) for c in rng.sample(ids, 8) if s != c}
    positives = [(s, c) for s in range(6) for c in rng.sample([x for x in ids if x != s], 5)]
    pool = spark.createDataFrame([(i,) for i in ids], "id long")
    got = G.rank_sparse(pool, spark.createDataFrame(positives, "src long, tgt long"), spark.createDataFrame([(s, c, x) for (s, c), x in scores.items()], "src long, id long, score double"), own=True)
    want = {(s, c, 1 + sorted((x for x in ids if x != s), key=lambda x: (-scores.get((s, x), 0.0), x)).index(c)) for s, c in positives}
    assert {(r.src, r.tgt, r.rank) for r in got.collect()} == want


def test_content_best_equals_ranking_by_definition(spark, monkeypatch):
    """Distinct texts in tiles, their copies counted: more copies than go together, nodes without text, equal scores."""
    monkeypatch.setattr(T, "IDS", 3)
    monkeypatch.setattr(T, "TILE", 4)
    kinds = ["red nut", "red bolt", "blue nut", "nut red", "blue cog of", None, "of", "red red nut"]
    texts = {i: kinds[i * i % 8] if i % 5 else kinds[i % 3] for i in range(60)}
    win = {i: "fit" if i < 36 else "val" if i < 46 else "test" for i in range(60)}
    edges = sorted({(s, (s * 7 + k * 11 + k * k) % 60) for s in range(60) for k in range(4)})
    edges = [(s, t) for s, t in edges if s != t]
    graph = T.G.Graph(None, spark.createDataFrame(edges, "src long, tgt long"))
    wins, rows = spark.createDataFrame(list(win.items()), "id long, win string"), spark.createDataFrame(list(texts.items()), "id long, text string")
    for recipes in ((T.Recipe(),), (T.Recipe(), T.Recipe(letters=True))):
        vectors = {}
        fit = wins.where("win = 'fit'").select("id")
        for n, r in enumerate(recipes):
            for x in T.tfidf(rows, fit, r).collect():
                vectors.setdefault(x.id, {})[n, x.term] = x.x
        cos = lambda a, b: round(sum(x * vectors.get(b, {}).get(t, 0) for t, x in vectors.get(a, {}).items()), 9)  # noqa: E731, B023
        for stage, whole in (("test", False), ("val", False), ("test", True)):
            pool, want = [i for i in win if whole or win[i] != "test"], {}
            for s in range(60):
                order = sorted((i for i in pool if i != s), key=lambda i: (-cos(s, i), i))
                ranks = [order.index(t) + 1 for a, t in edges if a == s and t in order]
                if win[s] == stage and ranks:
                    want[s] = min(ranks), len(ranks)
            got = T.content_best(graph, wins, rows, recipes, stage, whole).collect()
            assert {r.source: (r.best_rank, r.n_reachable) for r in got} == want


def test_document_weights_with_few_common_terms(spark):
    rows = [(1, "a b b c"), (1, "c d"), (2, "a E"), (3, None), (4, "1 2"), (None, "a f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    tf = Counter((d, w) for d, t in rows for w in re.findall("[a-z]+", (t or "").lower()))
    df = Counter(w for _, w in tf)
    for (d, w), k in tf.items():
        want[d, w] = (1 + math.log(k)) * (math.log((1 + len(rows)) / (1 + df[w])) + 1)
    norm = Counter()
    for (d, _), x in want.items():
        norm[d] += x * x
    for common in (2, 100):
        got = {(r.doc_id, r.term): r.x for r in T.document_weights(docs, "[a-z]+", common).collect()}
        assert set(got) == set(want) and all(abs(x - want[k] / norm[k[0]] ** 0.5) < 1e-12 for k, x in got.items())
    plan = T.document_weights(docs, "[a-z]+")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
