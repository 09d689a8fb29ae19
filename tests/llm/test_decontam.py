"""Regions against a plain search, repeated texts, short and repeated items, and odd columns."""

import random
import time

import numpy as np

from graphloom.llm import decontam


def _letters(t):
    return "".join(c for c in t.lower() if c.isalnum())


def _distance(a, b):
    """Least edits of the whole of ``a`` within ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_documents_found_equal_a_plain_search():
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    items = [(i, say(rnd.randint(20, 90))) for i in range(8)]
    index = decontam.Index(items)
    for _ in range(60):
        i, t = rnd.choice(items)
        w = [rnd.choice("abcdefgh") if rnd.random() < rnd.choice([0, 0.03, 0.08]) else x for x in t]
        text = say(30) + "".join(w) + say(30)
        c, _ = decontam.letters(text)
        got = {w for w, *_ in index.find(c)}
        plain = "".join(map(chr, c))
        want = {k for k, code in enumerate(index.codes) if _distance("".join(map(chr, code)), plain) <= index.budget[k]}
        assert got == want


def test_repeated_letters_take_little_time_and_memory():
    index = decontam.Index([(0, "word " * 60), (1, "abcdefg " * 40), (1, "abcdefg " * 40)])
    for text in ("word " * 4_000, "word " * 50_000):
        c, _ = decontam.letters(text)
        began = time.time()
        found = index.find(c)
        spans = {}
        for w, a, b, _ in found:
            spans.setdefault(w, []).append((a, b))
        assert time.time() - began < 10 and spans
        assert all(b <= x + decontam.Q for s in spans.values() for (_, b), (x, _) in zip(s, s[1:], strict=False))
        assert min(a for s in spans.values() for a, _ in s) == 0 and max(b for s in spans.values() for _, b in s) >= len(c) - 40


def test_items_of_few_letters_and_equal_items(spark):
    items = [(1, "x-y z!"), (2, "Q7"), (3, "the very same passage of text"), (4, "the very same passage of text"), (5, ""), (None, None)]
    docs = [(1, "so x y z it is", 1), (2, "axyz xyzb q77 aq7", 2), (3, "(q7)", 3), (4, "and the very same passage of text", 4), (None, "q7", 5), (6, None, 6), (7, "", 7)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in decontam.matches(rows, bench).collect()}
    assert got == {(1, 1, 3, 8), (3, 2, 1, 3), (4, 3, 4, 33), (4, 4, 4, 33), (None, 2, 0, 2)}
    kept = sorted((r.item_id for r in decontam.without_leaks(rows, bench).collect()))
    assert kept == [2, 5, 6, 7]  # a row without an id can't be named, so it stays
    assert decontam.without_leaks(rows.limit(0), bench).count() == 0 and np.array_equal(rows.columns, decontam.without_leaks(rows, bench).columns)
