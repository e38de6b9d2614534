"""The filter audit against plain counting over every order."""

import random
from collections import Counter
from itertools import permutations

import pytest

from marketlake.llm import audit, tries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, mask string, part string, n string"


def brute(rows, labels):
    blanks = " \t\n\v\f\r"
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    for doc_id, text, source in rows:
        text = text or ""
        words = "".join(" " if c in blanks else c for c in text).split(" ")
        words = [w for w in words if w]
        smaller = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": smaller}
        docs.append((source or "", {f for f, x in fails.items() if x}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for _, fails, _, _ in own:
                hit = [f for f in order if f in fails]
                if hit:
                    shapley[hit[0]] += 1
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fail = sum(f in d[1] for d in own)
                out[part, "".join(order), step] = (
                    len(left), len(gone), fail - len(gone), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone), shapley[f])
    return out


def found(spark, rows, labels, partitions=3):
    docs = spark.createDataFrame([(i, t, "x", s, 3, "p", "m", "q", "k") for i, t, s in rows], SCHEMA).repartition(partitions)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in audit.audit(docs, said).collect()}


def words(n, distinct, r=random.Random(1)):
    return " ".join(f"w{r.randrange(distinct)}" for _ in range(n))


MANY = words(300, 400)
CASES = {
    "empty table": ([], []),
    "nulls": ([(1, None, None), (2, "", "a"), (None, "", "a"), (None, MANY, "b"), (3, MANY, None), (4, MANY, "b"), (5, " \t", "a")],
              [(1, None, 1), (None, 1, 1), (4, 1, None), (4, 0, 1)]),
    "repeated rows": ([(7, MANY, "a"), (7, MANY, "a"), (7, MANY, "b"), (8, MANY, "a"), (8, MANY, "a"), (2, "x", "a"), (2, "y", "a")],
                      [(7, 1, 0), (8, 0, 1), (8, 0, 1)]),
    "signs": ([(1, "A" * 3 + "b" * 97, "s"), (2, "A" * 2 + "b" * 98, "s"), (3, words(250, 10), "s"), (4, MANY + " #", "s"), (5, "é€😀|", "s"),
               (6, "a\x1cb\x85c\xa0d", "s")], [(3, 1, 0), (4, 1, 1)]),
    "long": ([(1, "ab " * 200_000, "s"), (2, "ab " * 200_000, "t"), (3, "ab " * 200_000 + "c", "s")], [(2, 1, 1)]),
}


@pytest.mark.parametrize("case", CASES)
def test_against_counting(spark, case):
    rows, labels = CASES[case]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_copies_and_shared_beginnings(spark, monkeypatch):
    """A third of the rows share one text, a third begin alike in over 300 bytes; tries are emptied often."""
    r = random.Random(3)
    rows = [(i, MANY, "hot") for i in range(300)]
    rows += [(i, "begin " * 80 + words(3, 40, r), "src") for i in range(300, 600)]
    rows += [(i, words(r.choice([1, 2, 250]), 30, r), None) for i in range(600, 900)]
    r.shuffle(rows)
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 900, 2)]
    want = brute(rows, labels)
    assert found(spark, rows, labels, 5) == want
    monkeypatch.setattr(tries, "HELD", 5_000)
    monkeypatch.setattr(tries, "PREFIX", 16)
    assert found(spark, rows, labels, 5) == want


def test_trie_holds_what_was_put_in():
    r = random.Random(5)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randrange(9))) for _ in range(400)]
    trie, least = tries.Trie(), {}
    for i, key in enumerate(r.sample(keys, len(keys))):
        trie.add(key, 1_000 - i, ("p", 0), 1)
        least[key] = 1_000 - i
    assert {key: node.least for key, node in trie.terminals()} == least
    single = [node for node in [trie.root, *trie.root.below.values()] if node.least is None and len(node.below) == 1 and node.label]
    assert not single  # an edge ends where something branches or ends


def test_ranges_follow_the_weights():
    trie = tries.Trie()
    for i in range(1_000):
        trie.insert(b"common beginning " + str(i).encode()).weight += 10
    trie.insert(b"z").weight += 2_000
    borders, split = trie.ranges(1_000)
    assert 9 <= len(borders) <= 22 and borders == sorted(borders)
    assert all(b == b"z" or b.startswith(b"common beginning ") for b in borders) and not split
    one = tries.Trie()
    one.insert(b"same").weight += 10_000
    assert one.ranges(1_000) == ([], {b"same": 11})


def test_copies_leave_a_partition_once(spark):
    docs = spark.createDataFrame([(i, MANY, "s") for i in range(1_000)], "doc_id long, text string, source string").repartition(4)
    plan = tries.marked(docs, audit.failed, 16)
    assert sum(r["n"] for r in plan.collect()) == 1_000
    assert plan.filter("mask >= 16").count() == 999
