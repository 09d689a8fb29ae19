"""Licence scans on a small tree."""

from graphloom.llm.licenses import TEMPLATES, Templates, license_scan

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/c/x.py", "nothing to see"),
    (3, "a/b/y.py", "Some prose before. Licensed under the Apache License, Version 2.0. " + "And prose after it. " * 20),
    (4, "z/w.py", None),
    (5, None, ""),
    (5, None, ""),
    (6, "a/b/LICENSE", "Licensed under the GNU General Public License version 3"),
]


def test_headers_files_and_nearest_ancestors(spark):
    rows = spark.createDataFrame([(*x, "clash") for x in FILES], "id long, path string, text string, license string")
    got = sorted(tuple(r) for r in license_scan(rows).select("id", "license", "how", "inherited_from").collect())
    want = [(1, "MIT", "file", None), (2, "GPL-3.0", "inherited", "a/b"), (3, "Apache-2.0", "header", None), (4, "", "none", None), (5, "", "none", None), (5, "", "none", None), (6, "GPL-3.0", "file", None)]
    assert got == want
    assert license_scan(rows.limit(0)).count() == 0


def test_remembered_passages_score_the_same():
    warm = Templates(TEMPLATES)
    first = [warm.scan(t or "") for _, _, t in FILES]
    assert [warm.scan(t or "") for _, _, t in FILES] == first == [Templates(TEMPLATES).scan(t or "") for _, _, t in FILES]


def test_a_short_header_is_no_licence_of_its_directory(spark):
    rows = [(1, "src0/en/1", "Some words. Licensed under CC BY-NC 4.0."), (2, "src0/en/2", "another text of the same directory"), (3, "lib/COPYING", "Licensed under CC BY-NC 4.0."), (4, "lib/x", "no word of it")]
    got = {r.id: (r.license, r.how, r.inherited_from) for r in license_scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {1: ("CC-BY-NC-4.0", "header", None), 2: ("", "none", None), 3: ("CC-BY-NC-4.0", "file", None), 4: ("CC-BY-NC-4.0", "inherited", "lib")}
