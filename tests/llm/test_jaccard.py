"""Groups of near copies at both thresholds, over common lines and all sizes."""

import random

import pytest

from graphloom.llm import jaccard


def _brute(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    post, part = {}, {i: i for i in sets}

    def top(x):
        while part[x] != x:
            part[x] = x = part[part[x]]
        return x

    for i, s in sets.items():
        for g in s:
            post.setdefault(g, []).append(i)
    for i, s in sets.items():
        n = {}
        for g in s:
            for j in post[g]:
                if j < i:
                    n[j] = n.get(j, 0) + 1
        for j, c in n.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                part[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def _clusters(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(3))
    lines = [[word() for _ in range(rnd.randint(4, 30))] for _ in range(6)]
    docs = []
    while len(docs) < n:
        base = [word() for _ in range(rnd.choice([2, 5, 9, 14, 20, 40, 90, 200]))]
        for _ in range(rnd.choice([1, 1, 2, 3, 12, 60])):
            rate = rnd.choice([0, 0.004, 0.01, 0.02, 0.03])
            w = [word() if rnd.random() < rate else x for x in base]
            at = rnd.randint(0, len(w))
            if rnd.random() < 0.4:
                w[at:at] = rnd.choice(lines)
            docs.append((len(docs) * 7 % 5003 if n < 5000 else len(docs), " ".join(w)))
    return docs


@pytest.mark.parametrize("k,num", [(5, 80), (4, 85)])
def test_clusters_equal_brute_force(spark, k, num):
    docs = _clusters(2000, k)
    got = jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), k, num, 100).collect()
    want = _brute(docs, k, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 100 < len({c for _, c in want.values()}) < 1900


def test_small_blocks_give_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    docs = _clusters(400, 9)
    got = jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _brute(docs, 5, 80, 100)
