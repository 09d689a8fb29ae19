"""Predictions against naive Bayes written out, held-out accuracy, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import language

DOCS = "doc_id long, text string, lang string, source string, score int"


def grams(text):
    """The n-grams of a text by definition: letters inside, a space at either end at most."""
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    s = " " + " ".join(s.split()) + " "
    out = [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)]
    return [g for g in out if g.strip() and " " not in g[1:-1]]


def test_ngrams_equal_the_definition():
    texts = ["Hello, world", "", None, "a", " é  b1c ", "x\U0001d4b3y", "ÀB-c" * 5, "İz", "long word " * 120_000]
    got: dict[int, Counter] = {}
    for row, bucket in language._parts(texts):
        for r, b in zip(row.tolist(), bucket.tolist()):
            got.setdefault(r, Counter())[b] += 1
    code = {}
    for k, t in enumerate(texts):
        want = Counter(grams(t))
        assert got.get(k, Counter()).total() == want.total()
        # the same n-gram has the same bucket wherever it stands
        assert sorted(got.get(k, Counter()).values()) == sorted(Counter({b: n for b, n in _merged(want, code).items()}).values())


def _merged(want, code):
    out = Counter()
    for g, n in want.items():
        if g not in code:
            rows = [(r, b) for row, bucket in language._grams([(0, g.strip())]) for r, b in zip(row.tolist(), bucket.tolist())]
            names = grams(g.strip())
            code.update({x: b for x, (_, b) in zip(names, rows, strict=True)})
        out[code[g]] += n
    return out


def test_scores_equal_the_formula(spark):
    rows = [(k, t, lang, "x", 0) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 40)]
    rows += [(1000 + k, t, None, None, 1) for k, t in enumerate(["the dog", "die Hunde", "1234 !!", "", None, "le chien noir", "x" * 900_000])]
    got = {r.doc_id: r for r in language.language(spark.createDataFrame(rows, DOCS)).collect()}
    learnt = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    names = ["de", "en", "fr"]
    n = {x: Counter() for x in names}
    code = {}
    for _, t, lang, _, _ in learnt:
        n[lang] += _merged(Counter(grams(t)), code)
    for i, t, *_ in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not grams(t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        own = _merged(Counter(grams(t)), code) if i != 1006 else None
        if own:
            logs = np.array([math.log(sum(x[2] == lang for x in learnt) / len(learnt)) + sum(k * math.log((n[lang][b] + language.ALPHA) / (n[lang].total() + language.ALPHA * language.BUCKETS)) for b, k in own.items()) for lang in names])
            assert r.lang_pred == names[int(logs.argmax())]
            assert r.score == pytest.approx(1 / np.exp(logs - logs.max()).sum(), abs=1e-3)


def test_held_out_documents_and_no_leak(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.language(docs).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.95
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.language(other).collect()} == {k: (r.lang_pred, r.score) for k, r in got.items()}


def test_odd_rows(spark):
    rows = [(1, "some words", "en", None, 0)] * 3 + [(None, "des mots", "fr", "s", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, r.held_out, r.lang_pred) for r in language.language(df).collect()]
    assert sorted(got, key=str) == sorted([(1, False, "en")] * 3 + [(None, False, "fr"), (None, False, "und")], key=str)
    assert language.language(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.language(spark.createDataFrame([(1, "abc", None, None, 0)], DOCS)).collect()} == {"und"}
