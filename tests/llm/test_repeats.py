"""Repeated strings against a dictionary of all strings, and the interval tree against its definition."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlake.llm import repeats
from marketlake.llm.queries import QUERIES

LENGTH, GRAM = 24, 7


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, texts):
        gone = np.zeros(len(d) + 1, np.int8)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = 1
        gone[-1] = 0
        kept = bytes(np.frombuffer(d, np.uint8)[gone[:-1] == 0])
        out.append((doc, len(d), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, length=LENGTH, gram=GRAM):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, gram long, kept string, spans int")
    found = repeats.without_repeats(docs.repartition(3), length, gram)
    return sorted(map(tuple, found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


def passages(r, n):
    """Texts that share passages of all lengths about the limit, in all surroundings."""
    pool = ["".join(r.choice("abcdeé") for _ in range(r.randint(LENGTH - 6, LENGTH * 3))) for _ in range(8)]
    for i in range(n):
        yield i, "".join(r.choice([r.choice(pool), r.choice(pool)[r.randrange(20):], "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))])
                         for _ in range(r.randint(0, 6)))


r = random.Random(6)
BASE = "".join(r.choice("abcdefghij ") for _ in range(300))
CASES = {
    "none": [], "odd": [(None, None), (1, ""), (2, "x" * LENGTH), (3, "short"), (None, "short")],
    "overlap": [(1, "a" * (LENGTH + 1)), (2, "b" * LENGTH), (3, "ab" * LENGTH), (4, "c" * 500)],
    "rows twice": [(1, BASE), (1, BASE), (2, BASE[10:90])],
    "prefix and suffix": [(i, BASE[i:i + 60]) for i in range(0, 240, 7)],
    "border": [(i, f"{r.random()}"[:9] + BASE[50:50 + LENGTH + i % 3 - 1] + f"{r.random()}") for i in range(40)],
    "long": [(1, "".join(r.choice("xyz") for _ in range(30_000))), (2, BASE * 20)],
    "passages": list(passages(random.Random(8), 250)),
}


@pytest.mark.parametrize("case", CASES)
def test_against_all_strings(spark, case):
    assert got(spark, CASES[case]) == brute(CASES[case], LENGTH)


def test_grams_with_many_envelopes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 5)
    monkeypatch.setattr(repeats, "SPREAD", 0)
    monkeypatch.setattr(repeats, "BATCH", 500)
    for case in ("border", "passages"):
        assert got(spark, CASES[case]) == brute(CASES[case], LENGTH)


def test_query(spark, sf):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op5_suffix_array_dedup"](spark, sf).collect()), key=str) == brute(rows, 200)


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_anchors_split_all_strings_and_follow_the_bytes(monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    r = random.Random(1)
    for _ in range(40):
        data = bytes(r.choice(b"abc") for _ in range(r.randint(0, 400)))
        rows = repeats.anchors(data, LENGTH, GRAM)
        assert [s for a, b in rows[:, 2:].tolist() for s in range(a, b + 1)] == list(range(max(0, len(data) - LENGTH + 1)))
        again = repeats.anchors(b"zz" + data + b"zz", LENGTH, GRAM)
        of = {s: p - s for p, _, a, b in again.tolist() for s in range(a, b + 1)}
        assert all(of[s + 2] == p - s for p, _, a, b in rows.tolist() for s in range(a, b + 1))


def envelopes(texts, length):
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [pa.array([1] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array([len(t) - length + 1 for t in texts], pa.int32()),
         pa.array([-1] * n, pa.int32()), pa.array(texts, pa.binary())], names=["gram", "text_id", "first", "starts", "left", "bytes"])


def test_large_batches_are_worked_on_in_parts(monkeypatch):
    """A suffix array takes a hundred times its bytes: those of a whole batch took most of an executor's memory."""
    monkeypatch.setattr(repeats, "BATCH", 20_000)
    grams = [g for g in range(2_000) for _ in range(1 + g % 3)]
    rows = pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array([b"x" * 100] * len(grams), pa.binary())], names=["gram", "bytes"])
    parts = []

    def work(part, schema):
        parts.append((part.nbytes, part["gram"].to_pylist()))
        yield part

    list(repeats._by_grams(iter([rows, rows.slice(0, 0)]), work, rows.schema))
    assert max(size for size, _ in parts) < 3 * 20_000
    assert [g for _, part in parts for g in part] == grams
    assert all(a[-1] != b[0] for (_, a), (_, b) in zip(parts, parts[1:]))


def test_settled_suffixes_are_not_ranked_again(monkeypatch):
    r = np.random.default_rng(3)
    rows = envelopes([r.integers(0, 200, 300, np.uint8).tobytes() for _ in range(50)], 200)
    sorted_, argsort = [], np.argsort
    monkeypatch.setattr(repeats.np, "argsort", lambda x, *a, **k: sorted_.append(len(x)) or argsort(x, *a, **k))
    repeats.Envelopes(rows, 200)
    assert sum(sorted_) < 2 * 50 * 301


@pytest.mark.parametrize("length", [3, 8, 20, 64])
def test_depths_are_those_of_the_strings(length):
    r = random.Random(length)
    pool = [bytes(r.choice(b"ab\0\xf4") for _ in range(r.choice([5, 30, 90, 128]))) for _ in range(5)] + [b"a" * 150, b"\0" * 70]
    for _ in range(15):
        texts = [b"".join(r.choice(pool) for _ in range(r.randint(1, 3))) for _ in range(6)]
        texts = [t + bytes(r.choice(b"ab") for _ in range(length)) for t in texts]
        found = repeats.Envelopes(envelopes(texts, length), length)
        suffixes = sorted((t[s:], i, s) for i, t in enumerate(texts) for s in range(len(t) - length + 1))
        common = [0, *(repeats._alike(a, b) for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:])), 0]
        want = {(i, s): max(common[k], common[k + 1]) for k, (_, i, s) in enumerate(suffixes)}
        have = dict(zip(zip(found.text.tolist(), found.start.tolist()), found.depths().tolist()))
        assert have == {k: d if d >= length else 0 for k, d in want.items()}


def test_interval_tree_and_left_diversity():
    """Every repeated string is an interval; it is maximal if it can't be extended to the left within the texts."""
    r = random.Random(2)
    for _ in range(30):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(9, 30))) for _ in range(4)]
        starts = [len(t) - 3 for t in texts]
        rows = pa.RecordBatch.from_arrays(
            [pa.array([1] * 4), pa.array(range(4)), pa.array([0] * 4, pa.int32()), pa.array(starts, pa.int32()), pa.array([-1] * 4, pa.int32()),
             pa.array(texts, pa.binary())], names=["gram", "text_id", "first", "starts", "left", "bytes"])
        found = repeats.Envelopes(rows, 4)
        occurrences = defaultdict(list)
        for i, t in enumerate(texts):
            for s in range(len(t) - 3):
                for e in range(s + 4, len(t) + 1):
                    occurrences[t[s:e]].append((i, s))
        want = {}
        for string, at in occurrences.items():
            ahead = {texts[i][s + len(string)] if s + len(string) < len(texts[i]) else (i, s) for i, s in at}
            if len(at) > 1 and len(ahead) > 1:
                behind = {texts[i][s - 1] if s else (i, s) for i, s in at}
                want[string] = (sorted(at), len(behind) > 1)
        have = {}
        for depth, places, is_maximal in found.repeats():
            at = sorted(zip(found.text[places].tolist(), found.start[places].tolist()))
            have[texts[at[0][0]][at[0][1]:at[0][1] + depth]] = (at, is_maximal)
        assert {k for k, (_, m) in want.items() if m} <= set(have)
        assert all(have[k] == w or len(have[k][0]) < len(w[0]) for k, w in want.items() if k in have)


def test_maximal_repeats_are_reported_with_all_occurrences(spark):
    docs = spark.createDataFrame([(i, f"{i}" * 9 + BASE[100:150] + f"{i + 5}" * 9) for i in range(4)], "doc_id long, text string")
    found = repeats.maximal_repeats(docs, LENGTH, GRAM).toPandas()
    widest = found[found.length == found.length.max()]
    assert widest.length.max() <= 50 and (found.groupby("repeat").size() >= 2).all()
    assert widest.groupby("repeat").text_id.nunique().max() == 4


def maximal(rows, length):
    """All maximal repeats by definition: the repeated strings that end or start differently somewhere."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    classes, want = [defaultdict(list)], set()
    for k, (_, d) in enumerate(texts):
        for s in range(len(d) - length + 1):
            classes[0][d[s:s + length]].append((k, s))
    level, size = classes[0], length
    while level:
        after = defaultdict(list)
        for string, at in level.items():
            if len(at) < 2:
                continue
            behind = {texts[k][1][s - 1] if s else (k, s) for k, s in at}
            ahead = {texts[k][1][s + size] if s + size < len(texts[k][1]) else (k, s) for k, s in at}
            if len(behind) > 1 and len(ahead) > 1:
                want.add((hashlib.sha256(string).hexdigest(), size, tuple(sorted((texts[k][0] or 0, s) for k, s in at))))
            for k, s in at:
                if s + size < len(texts[k][1]):
                    after[string + texts[k][1][s + size:s + size + 1]].append((k, s))
        level, size = after, size + 1
    return want


def groups(spark, rows, length=LENGTH, gram=GRAM):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r.text_id: r.doc_id or 0 for r in docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("text_id")).collect()}
    found = defaultdict(list)
    for r in repeats.maximal_repeats(docs.repartition(3), length, gram).collect():
        found[r.repeat, r.length].append((ids[r.text_id], r.start))
    return {(*k, tuple(sorted(v))) for k, v in found.items()}


MAXIMAL = {
    "a copy that quotes": [(i, BASE) for i in range(30)] + [(99, "0123456789" + BASE[40:200] + "zz")],
    "passages": list(passages(random.Random(8), 40)), "border": CASES["border"], "rows twice": CASES["rows twice"],
    "overlap": CASES["overlap"][:3] + [(4, "c" * (LENGTH + 10))], "odd": CASES["odd"],
}


@pytest.mark.parametrize("group", [20, 16_384])
def test_maximal_repeats_by_definition(spark, monkeypatch, group):
    """One corpus of all cases, as rounds are the same; large grams and classes must give the same groups as small ones."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = [(None if i is None else at * 1_000 + i, t and f"{t}") for at, case in enumerate(MAXIMAL) for i, t in MAXIMAL[case]]
    assert groups(spark, rows) == maximal(rows, LENGTH)


def test_long_maximal_repeats_are_whole(spark):
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(2_600))
    rows = [(i, text + f"{i}" + BASE[:40]) for i in range(3)]
    assert groups(spark, rows) == {(hashlib.sha256(x.encode()).hexdigest(), len(x), tuple((i, at) for i in range(3)))
                                   for x, at in ((text, 0), (BASE[:40], 2_601))}


def test_maximal_repeats_cover_what_is_removed(spark):
    rows = CASES["passages"][:80]
    covered = defaultdict(set)
    for _, size, at in groups(spark, rows):
        for i, s in at:
            covered[i] |= set(range(s, s + size))
    assert {i: n for i, _, n, *_ in brute(rows, LENGTH) if n} == {i: len(c) for i, c in covered.items()}
