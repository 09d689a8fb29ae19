"""Scores see texts alone, and a whole score equals one worked out plainly."""

import random

import numpy as np
import pytest

from graphloom.llm import toxicity


def _corpus(n=900, seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    vile = ["zqvile", "zqhate", "zqfoul"]
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [word() for _ in range(30)]
        if bad:
            w[10:10] = [rnd.choice(vile) for _ in range(6)]
        docs.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


def _scores(spark, docs, labels):
    rows = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {r.doc_id: (r.held_out, r.score, r.predicted) for r in rows.collect()}


def test_equal_texts_score_the_same_and_held_out_labels_change_nothing(spark, corpus):
    docs, labels = corpus
    copies = [(i + 10_000, t) for i, t in docs]
    got = _scores(spark, docs + copies, labels)
    assert all(got[i][1] == got[i + 10_000][1] for i, _ in docs)
    turned = [(i, q, 1 - t if got[i][0] else t) for i, q, t in labels]
    assert _scores(spark, docs + copies, turned) == got
    held = [(got[i][2], t) for i, _, t in labels if got[i][0]]
    assert np.mean([p == t for p, t in held]) > 0.95


def test_one_class_or_no_labels_score_near_the_base_rate(spark, corpus):
    docs, labels = corpus
    for some in ([x for x in labels if x[2] == 0], labels[:0]):
        got = _scores(spark, docs[:50], some)
        assert len(got) == 50 and all(p == 0 and 0 <= s <= 1 for _, s, p in got.values())
