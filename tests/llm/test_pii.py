"""Disclosing terms against their definition, and where they stand."""

import math
import random
import re

import pytest

from graphloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
TERM = re.compile(r"[^\W\d_]{4,}")


def _corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["about", "again", "other", "their", "where", "which", "while"])
    values = {f"{v}@corp.example": [f"Name{v}", f"Straße{v}"] for v in "abcdef"}
    docs = []
    for i in range(260):
        w = [word() for _ in range(12)]
        if i % 4 == 0:
            v = rnd.choice(sorted(values))
            near = [x for x in values[v] if rnd.random() < 0.8]
            w += [f"({x})," for x in near] + [v if rnd.random() < 0.9 else v.upper(), f"nr{i}"]
        elif rnd.random() < 0.05:
            w.append("nameb")
        docs.append((i, " ".join(w)))
    return docs + [(1000 + k, docs[4][1]) for k in range(5)]


def _terms(docs):
    of = {i: ({v.lower() for v in EMAIL.findall(t)}, {x.lower() for x in TERM.findall(EMAIL.sub(" ", t))}) for i, t in docs}
    out = set()
    for v in {v for vs, _ in of.values() for v in vs}:
        n_e, texts = sum(v in vs for vs, _ in of.values()), {t for i, t in docs if v in of[i][0]}
        if len(texts) < pii.SUPPORT:
            continue
        for x in {x for vs, xs in of.values() if v in vs for x in xs}:
            both = [i for i, (vs, xs) in of.items() if v in vs and x in xs]
            n_t = sum(x in xs for _, xs in of.values())
            pmi, ic = math.log(len(both) * len(docs) / (n_e * n_t)), math.log(len(docs) / n_e)
            if len({t for i, t in docs if i in both}) >= pii.SUPPORT and pmi >= pii.DISCLOSURE * ic - 1e-12:
                out.add(x)
    return out


@pytest.mark.parametrize("most", [pii.LIST, 0])
def test_terms_and_their_places_equal_the_definition(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "LIST", most)
    docs = _corpus() + [(2000, "İİİ NAMEA, strASSEa straßeB; namea@x.yy namec-named")]
    want = _terms(docs)
    assert {"namea", "straßeb"} <= want
    found = pii.personal_data(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, terms string"))
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.terms] for r in found.select("doc_id", "terms").collect()}
    assert got == {i: [m.span() for m in TERM.finditer(t) if m.group().lower() in want] for i, t in docs}


def test_nothing_is_cut_behind_letters_that_grow_when_lowered(spark):
    rows = _corpus() + [(2000, "İİİ only NameA here")]
    out = {r.doc_id: r.text for r in pii.without_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2000] == "İİİ only [TERM] here"
