"""Operators take whole documents, whole licences and partial passages."""

import random

from graphloom.llm import decontam, pii
from graphloom.llm.licenses import FULL, TEMPLATES, Templates, license_scan


def test_pii_terms_from_whole_documents_and_copies(spark):
    far = "filler words that go on and on for well over fifty characters of text "
    rows = [(i, f"(Zelphora): {far} sam@corp.example says nr {'abcd'[i]}") for i in range(4)]
    rows += [(10 + i, rows[0][1]) for i in range(30)] + [(100 + i, f"{far} says nr {i}") for i in range(60)]
    rows.append((900, "only zelphora here"))
    out = {r.doc_id: r.text for r in pii.without_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[900] == "only [TERM] here" and out[10] == f"([TERM]): {far} [EMAIL] says nr a" and out[100] == rows[34][1]


def test_full_licence_texts_are_files_and_all_licences_are_given(spark):
    t = Templates(TEMPLATES)
    for name, text in FULL.items():
        assert t.scan("Copyright (c) 2020 Someone\n\n" + text)[1:] == (name, "file"), name
    assert t.scan(FULL["Apache-2.0"] + FULL["MIT"])[1:] == ("Apache-2.0 AND MIT", "file")
    both = "Licensed under the Apache License, Version 2.0. " + "Some prose between. " * 20 + "Released under the MIT License." + " More prose." * 40
    assert t.scan(both)[1:] == ("Apache-2.0 AND MIT", "header")
    assert t.scan(both, "a/COPYING")[1:] == ("Apache-2.0 AND MIT", "file")
    rows = spark.createDataFrame([(1, "a/LICENSE.txt", FULL["MIT"]), (2, "a/b/x.py", "nothing to see"), (3, "c/y.py", "int x;")], "id long, path string, text string")
    assert {r.id: (r.license, r.how) for r in license_scan(rows).collect()} == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("", "none")}


def test_partial_passages_are_found_from_the_stated_length_on(spark):
    rnd = random.Random(5)
    say = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    length = decontam.PASSAGE + decontam.STRIDE - 1
    items = [(0, say(130)), (1, say(300))]
    docs = [(1000 * i + at, say(50) + t[at : at + length] + say(50)) for i, t in items for at in range(len(t) - length + 1)]
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, d // 1000) for d, _ in docs}
