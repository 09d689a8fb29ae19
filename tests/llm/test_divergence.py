"""Distances and marking terms against the definition, over few and many sources, and odd rows."""

import random
import re
from collections import Counter

from graphloom.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, value int"


def plain(rows, least=30, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= least]
        n = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        share = lambda c, size: 1 + 10**9 * (c + 5) // (size + 5 * len(kept))  # noqa: B023, E731
        every = sum(n.values(), Counter())
        q = {t: share(every[t], every.total()) for t in kept}
        p = {s: {t: share(n[s][t], n[s].total()) for t in kept} for s in n}
        for s in n:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in n if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if n[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def found(df, **more):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.source_divergence(df, **more).collect())


def test_equals_the_definition(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(600):
        words = [rnd.choice(["Alpha", "beta", "Gamma", "été", "ÉTÉ", "x", "zulu", "日本", "𝒳"])[: rnd.randint(1, 5)] for _ in range(rnd.randint(0, 30))]
        rows.append((k, rnd.choice([" ", "-", "\n", "1"]).join(words), rnd.choice(["en", "en", "fr", None]), rnd.choice(["a", "a", "b", "c", "", None, "Z"]), 0))
    rows += [(None, None, "de", "only", 1), (1, "", "xx", "p", 1), (2, "word " * 300_000, "xx", None, 1), (3, "word", "xx", "q", 1)]
    assert found(spark.createDataFrame(rows, DOCS)) == plain(rows)


def test_many_sources_and_shared_vectors(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice("abcdefghijkl") * 2 for _ in range(6)), "en", f"s{rnd.randint(0, 149)}", 0) for k in range(900)]
    rows += [(k, f"pair{chr(97 + k % 20)} twin{chr(97 + k % 20)}", "en", f"s{k % 3}", 0) for k in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    assert found(df, least=3, top=4) == plain(rows, 3, 4)
    entries = spark.createDataFrame([("en", t, s, 7, 2) for t in ("x", "y", "z") for s in ((0, 1) if t != "z" else (1,))], "lang string, term string, s int, p long, sources long")
    assert sorted((len(r.vector), r.m) for r in divergence.vectors(entries).collect()) == [(1, 1), (2, 2)]


def test_no_rows_and_no_terms(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
    rows = [(1, "a", "en", "p", 0), (2, "b", "en", "q", 0), (2, "b", "en", "q", 0)]
    assert found(spark.createDataFrame(rows, DOCS)) == [("en", "p", "pair", "q", 0, 1), ("en", "q", "pair", "p", 0, 1)]


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    n, size, kept = 3 * 10**15, 7 * 10**15, 10**6
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(size), F.lit(kept)).cast("long")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (size + 5 * kept)
