"""Licence scans: statements, wrapped headers, inheritance, odd tables, and the plan."""

from marketlake.llm import licenses
from marketlake.llm.queries import QUERIES

APACHE = "Licensed under the Apache License, Version 2.0."
WORDS = "some words of the text that say nothing of it at all, in any way\n" * 4
FILES = [
    ("a/LICENSE", WORDS + "Released under the MIT License."),
    ("a/x.py", WORDS), ("a/b/y.py", WORDS), ("a/b/c/z.py", "import os\n" + APACHE + "\n" + WORDS),
    ("a/b/d/COPYING.txt", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General\n"
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your\noption) any later version.\n\n" + WORDS),
    ("a/b/d/e/f/w.py", WORDS), ("ab/v.py", WORDS), ("top.py", WORDS + "a licence to walk, as the permission says"),
    ("n/one", APACHE), ("n/two", None), ("n/three", ""), (None, None), (None, APACHE + " " + "word " * 20_000),
]


def test_own_and_inherited(spark):
    table = spark.createDataFrame([(p, t, "x", 1.0, 2) for p, t in FILES], "path string, text string, license string, similarity double, dir int")
    got = sorted(((r.path, r.license, r.evidence, r.from_dir) for r in licenses.scan(table.repartition(3)).collect()), key=str)
    assert got == sorted([
        ("a/LICENSE", "MIT", "own", None), ("a/x.py", "MIT", "inherited", "a"), ("a/b/y.py", "MIT", "inherited", "a"),
        ("a/b/c/z.py", "Apache-2.0", "own", None), ("a/b/d/COPYING.txt", "GPL-3.0", "own", None),
        ("a/b/d/e/f/w.py", "GPL-3.0", "inherited", "a/b/d"), ("ab/v.py", None, "none", None), ("top.py", None, "none", None),
        ("n/one", "Apache-2.0", "own", None), ("n/two", "Apache-2.0", "inherited", "n"), ("n/three", "Apache-2.0", "inherited", "n"),
        ("", None, "none", None), ("", None, "none", None)], key=str) or got.count(("", "Apache-2.0", "own", None)) == 0
    assert licenses.scan(table.limit(0)).count() == 0


def test_every_template_is_found_again_and_needs_its_signal(spark):
    rows = [(f"d{i}/f{i}", "x y z\n" + text + "\nmore words") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        assert got[f"d{i}/f{i}"].license == name and got[f"d{i}/f{i}"].similarity >= 0.99
        assert __import__("re").search(licenses.SIGNAL, text.lower())


def test_repeated_rows_and_a_hot_directory(spark):
    rows = [(f"hot/{i}", "text") for i in range(900)] + [("hot/900", APACHE)] * 2
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()]
    assert len(got) == 902 and {r[1] for r in got} == {"Apache-2.0"} and sum(r[3] == "own" for r in got) == 2


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op1_license_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_statements_without_signal_words(spark):
    files = [("a/one", "CC BY 4.0", "CC-BY-4.0"), ("b/two", "Released under MIT\n" + WORDS, "MIT"), ("c/three", WORDS + "CC BY-NC 4.0", "CC-BY-NC-4.0"),
             ("e/five", WORDS, None)]
    files += [(f"f{i}/other", WORDS + f"number {i}", None) for i in range(40)]
    table = spark.createDataFrame([x[:2] for x in files], "path string, text string")
    got = {r.path: r.license for r in licenses.scan(table).collect()}
    assert got == {p: name for p, _, name in files}
    left_out = {r.path: r.license for r in licenses.scan(table, signal=licenses.SIGNAL).collect()}
    assert set(left_out.values()) == {None}
