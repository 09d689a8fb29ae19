"""Balance of delimiters against a stack, overlaps against all pairs."""

import random

from graphloom.operators import checks as C


def test_unbalanced_equals_a_stack(spark):
    rnd = random.Random(1)
    texts = {k: "".join(rnd.choice("()[]{}<>ab é\n") for _ in range(rnd.choice([0, 5, 200]))) for k in range(80)}
    texts |= {80: "(" * 70_000 + "é" * 70_000 + ")" * 100_000 + "[" + "x" * 70_000 + "]", 81: None}
    want = {}
    for k, t in texts.items():
        for pair in C.PAIRS:
            stack = closes = marks = 0
            for c in t or "":
                marks += c in pair
                if c == pair[0]:
                    stack += 1
                elif c == pair[1]:
                    closes, stack = (closes, stack - 1) if stack else (closes + 1, 0)
            if marks:
                want[k, pair] = (marks, closes, stack)
    got = C.unbalanced(spark.createDataFrame(list(texts.items()), "id long, text string"))
    assert {(r.id, r.pair): (r.marks, r.closes, r.opens) for r in got.collect()} == want


def test_overlaps_equal_all_pairs_without_a_nested_loop(spark):
    rnd = random.Random(2)
    boxes = [(k, x, x + rnd.choice([0, 1, 3, 30]), y, y + rnd.choice([0, 1, 2, 40])) for k in range(200) for x, y in [(rnd.randint(-50, 50) / 2, rnd.randint(-50, 50) / 2)]]
    df = C.overlapping(spark.createDataFrame([tuple(map(float, b[1:])) + (b[0],) for b in boxes], "x0 double, x1 double, y0 double, y1 double, id long"), 4.0, 4.0)
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] < b[2] and b[1] < a[2] and a[3] < b[4] and b[3] < a[4] and a[1] < a[2] and b[1] < b[2] and a[3] < a[4] and b[3] < b[4]}
    got = [(r.a, r.b) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_differing_counts_repeats(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "x string") for s in ("aabc", "abcd"))
    assert tuple(C.differing(a, b).first()) == (1, 1) and tuple(C.differing(a, a).first()) == (0, 0)


def test_versions_are_dealt_by_their_rows_once(spark):
    a, b = (spark.createDataFrame([(x, None) for x in s], "x string, y double") for s in ("aabc", "abcd"))
    plan = C.differing(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
