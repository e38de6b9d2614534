"""Near-duplicates against all pairs, and components against union-find."""

import random

import numpy as np
import pytest

from marketlake.llm import components, minhash
from marketlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, node long, label long, u long"


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(lambda x: (x,), w))


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


def brute(rows):
    """By row number; the ids of a component meet at the end."""
    found, union = [sets(t) for _, t in rows], Union()
    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a and b and 0.8 * len(a) <= len(b) * 1.0000001 and 0.8 * len(b) <= len(a) * 1.0000001:
                common = len(a & b)
                if 100 * common >= 80 * (len(a) + len(b) - common):
                    union.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            root = union.find(i)
            least[root] = min(least.get(root, doc), doc)
    return sorted(((doc, len(found[i]), c := least.get(union.find(i)), doc == c) for i, (doc, _) in enumerate(rows)), key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)


def variants(r, words, n, share):
    base = [f"w{r.randrange(5_000)}" for _ in range(words)]
    return [" ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in base) for _ in range(n)]


def test_families_of_near_copies(spark):
    r = random.Random(1)
    texts = [t for share in (0.01, 0.04, 0.06, 0.08) for _ in range(4) for t in variants(r, 120, 25, share)]
    r.shuffle(texts)
    rows = list(enumerate(texts + texts[:40]))
    assert got(spark, rows) == brute(rows)


def test_a_hub_that_is_not_linked_does_not_hide_links(spark, monkeypatch):
    """Copies far from each other but all near to one text; the least node of a bucket is hardly ever that text."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "ITEMS", 5_000)
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join(f"x{r.randrange(10**6)}" if r.random() < 0.045 else w for w in base) for _ in range(120)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one one"), (6, "É é"), (7, "é É"), (8, "a b\x0bc"),
            (8, "A B C"), (None, "a b c"), (9, "x\x85y z"), (10, "x y z"), (11, "one word"), (12, "a b"), (13, "b c a b"),
            (14, "z " * 60_000), (15, "z z"), (None, "alone in this table"), (16, "s t"), (16, "s t"), (17, "u v w x y z"), (17, "1 2 3 4")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_table(spark, sf):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op9_minhash_near_dedup"](spark, sf).collect()), key=str) == brute(rows)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.6, 0.8, 0.9):
        common = r.integers(0, 2**63, int(2_000 * share), np.uint64)
        own = [r.integers(0, 2**63, (2_000 - len(common)) // 2, np.uint64) for _ in "ab"]
        a, b = (minhash.minima(minhash._mixed(np.concatenate((common, o)))) for o in own)
        assert abs((a == b).mean() - share) < 0.09


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {"path": [(i + 1, i) for i in range(60)], "star": [(500, i) for i in range(400)], "none": [],
             "random": [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(7, 7)]}[kind]
    union = Union()
    for u, v in edges:
        union.join(u, v)
    want = sorted((x, union.find(x)) for x in list(union) if union.find(x) != x)
    found = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, found.collect())) == want


def test_outsiders_of_large_buckets(spark, monkeypatch):
    """Members of a bucket's largest component are copied for blocks of outsiders only, and every pair with an outsider meets once."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    shared = spark.createDataFrame([(7, i, 10) for i in range(1_001)] + [(8, i, 10) for i in range(0, 1_001, 4)], "key long, node long, n_shingles long")
    labels = spark.createDataFrame([(i, 0) for i in range(1, 1_000)], "node long, label long")
    one = minhash._open(shared, labels).filter("key = 7").collect()
    assert len(one) <= 1_001 + 1_000 // 32 + 1
    labels = spark.createDataFrame([(i, 0) for i in range(1, 900)], "node long, label long")
    parts = {}
    for r in minhash._open(shared, labels).collect():
        parts.setdefault((r["key"], r["part"]), []).append(r)
    met = {}
    for (key, _), rows in parts.items():
        assert len(rows) <= 160
        across = len({r["side"] for r in rows}) > 1
        for a in rows:
            for b in rows:
                if a["node"] < b["node"] and a["label"] != b["label"] and not (across and a["side"] == b["side"]):
                    met[key, a["node"], b["node"]] = met.get((key, a["node"], b["node"]), 0) + 1
    want = {(key, a, b) for key, nodes in ((7, range(1_001)), (8, range(0, 1_001, 4))) for b in nodes if b >= 900 for a in nodes if a < b}
    assert set(met) == want and set(met.values()) == {1}


def test_odd_column_names(spark):
    rows = [(1, "one two three four five", 5, 6, 7), (2, "one two three four five", 5, 6, 8), (3, "other words here", 5, 6, 9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "a.b", "_id", "_seen"])
    kept = minhash.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
