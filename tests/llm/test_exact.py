"""Exact de-duplication against a dictionary."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marketlake.llm import exact

SCHEMA = "doc_id long, text string, digest string, best_id long, n_chars long, row string"


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1] or ""), []).append(r)
    out = []
    for bare, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            kept = r[0] == best[0] and len(r[1] or "") == len(best[1] or "")
            out.append((r[0], best[0], len(members), kept, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 3, "y") for i, t in rows], SCHEMA)


CASES = {
    "empty table": [],
    "nulls": [(1, None), (2, ""), (3, " \t\r\n"), (None, "a"), (4, "a "), (None, None)],
    "ties": [(9, "a b"), (3, "ab "), (5, "a b"), (6, "a b"), (7, "ab")],
    "repeated": [(1, "same"), (1, "same"), (2, "sa me"), (2, "sa me")],
    "long": [(1, "x" * 300_000), (2, "x" * 150_000 + " " + "x" * 150_000), (3, "😀" * 5), (4, "😀" * 5 + "\n")],
    "hot": [(i, "hot text" if i % 3 else f"own {i}") for i in range(4_000)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("radix", [2, 16])
def test_against_brute_force(spark, case, radix):
    docs = table(spark, CASES[case]).repartition(5)
    got = sorted(map(tuple, exact.exact_duplicates(docs, partitions=7, radix=radix).collect()), key=str)
    assert got == brute(CASES[case])


def test_random(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("ab \n") for _ in range(r.randint(0, 6)))) for i in range(2_000)]
    got = sorted(map(tuple, exact.exact_duplicates(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("case", CASES)
def test_one_row_stays_for_each_text(spark, case):
    rows = CASES[case]
    left = exact.without_copies(table(spark, rows).repartition(3))
    assert left.columns == ["doc_id", "text", "digest", "best_id", "n_chars", "row"]
    want = {(w[0], w[4]) for w in brute(rows) if w[3]}
    got = [(r[0], hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", r[1] or "").encode()).hexdigest()) for r in left.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_run_is_folded_before_it_is_sent(spark):
    rows = table(spark, [(i, "hot") for i in range(1_000)]).repartition(4)
    runs = exact._run(exact.digests(rows).select(
        "digest", "n_bytes", "witness", F.col("n_chars").alias("best_chars"), F.col("doc_id").alias("best_id"),
        F.lit(1).cast("long").alias("best_rows"), F.lit(1).cast("long").alias("group_size")))
    assert runs.count() == 4


def test_digest_clash_is_found(spark):
    clash = exact.digests(table(spark, [(1, "a"), (2, "a")])).withColumn("witness", F.col("doc_id"))
    with pytest.raises(Exception, match="one SHA-256 digest"):
        exact.merge_runs(clash).collect()
