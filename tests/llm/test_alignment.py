"""Token alignment against one link at a time."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketlake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, a string, b string, container string, n string, plane string"


@pytest.fixture(scope="module")
def both():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def spans(lengths):
    at, out = 0, []
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def tokens(both, text):
    """Ids with their places, or nothing."""
    a, b = both
    if not text:
        return None
    data, of = (" " + text).encode(), alignment._byte_of()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    a_bytes = [bytes(of[c] for c in a.id_to_token(i)) for i in a_ids]
    pieces = [b.id_to_piece(i) for i in b_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, pieces)]
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return None
    return list(zip(a_ids, spans(map(len, a_bytes)))), list(zip(b_ids, spans(map(len, b_bytes))))


def brute(both, rows):
    docs, held = [], Counter()
    for doc_id, text in rows:
        found = tokens(both, text)
        if found is None:
            docs.append((doc_id, None, [], 0, ""))
            continue
        a, b = found
        links = [(i, j) for i, (s, e) in a for j, (u, v) in b if s < v and u < e]
        ends = sorted({e for _, (_, e) in a} & {e for _, (_, e) in b})
        shown, start = [], 0
        for end in ends:
            shown.append("|".join(",".join(str(i) for i, (s, e) in t if start < e <= end) for t in (a, b)))
            start = end
        held.update(set(links))
        docs.append((doc_id, found, links, len(ends), hashlib.sha256(";".join(shown).encode()).hexdigest()))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for doc_id, found, links, n_groups, digest in docs:
        n_a, n_b = map(len, found) if found else (0, 0)
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(out, key=str), held


def found(spark, rows, partitions=3):
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "n", "p") for i, t in rows], SCHEMA).repartition(partitions)
    return alignment.align(docs, A, B, public_tokenizers.PATTERN)


WORDS = "the token of unaligned Straße naïve 東京 буква 😀 don't 1234 <s> <|endoftext|> <0x41> ▁ x".split()
CASES = {
    "empty table": [],
    "nulls": [(1, None), (2, ""), (None, "a b"), (None, None), (3, "a b"), (3, "a b")],
    "signs": [(1, "  two  blanks "), (2, "\t\n\r\n \x0b"), (3, "a▁b"), (4, "<0x41> <s> </s> <unk> <|endoftext|>"), (5, "\x00\x01 \x7f"),
              (6, " 　​"), (7, "é ﬁ Å Å"), (8, "\U000323b0꟎ 😀👩‍👩‍👧"), (9, " "), (10, "﻿x"), (11, "a\x85b\x1cc")],
    "repeated": [(i % 7, "the same words again and again and again, again") for i in range(40)],
    "long": [(1, "again and again " * 800), (2, "x" * 3_000), (3, "again and again")],
}


@pytest.mark.parametrize("case", CASES)
def test_against_one_link_at_a_time(spark, both, case):
    rows = CASES[case]
    want, held = brute(both, rows)
    got = found(spark, rows)
    assert got.documents.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.documents.collect()), key=str) == want
    pairs = {(r["a"], r["b"]): r for r in got.pairs.collect()}
    assert {p: r["n_docs"] for p, r in pairs.items()} == dict(held)


def test_containers_dense_and_sparse(spark, both, monkeypatch):
    """Common pairs become bits, containers end at their slots, at their postings, and pieces are ORed."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(12)))) for i in range(900)]
    want, held = brute(both, rows)
    links = Counter()
    for _, text in rows:
        got = tokens(both, text)
        if got:
            links.update((i, j) for i, (s, e) in got[0] for j, (u, v) in got[1] if s < v and u < e)
    for slots, postings, together in ((4_096, 2_000_000, 1_000_000), (512, 300, 200)):
        monkeypatch.setattr(alignment, "SLOTS", slots)
        monkeypatch.setattr(alignment, "BITS", slots // 8)
        monkeypatch.setattr(alignment, "DENSE", slots // 16)
        monkeypatch.setattr(alignment, "POSTINGS", postings)
        monkeypatch.setattr(alignment, "TOGETHER", together)
        got = found(spark, rows, 2)
        assert sorted(map(tuple, got.documents.collect()), key=str) == want
        pairs = got.pairs.collect()
        assert {(p["a"], p["b"]): p["n_docs"] for p in pairs} == dict(held)
        assert {(p["a"], p["b"]): p["n_links"] for p in pairs} == dict(links)


def test_given_documents(spark, both, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 6_000]
    want, _ = brute(both, rows)
    assert sorted(map(tuple, found(spark, rows).documents.collect()), key=str) == want


def test_groups(spark, both):
    text = "unaligned Straße 東京"
    docs = spark.createDataFrame([(5, text), (6, None)], "doc_id long, text string")
    rows = alignment.groups(docs, A, B, public_tokenizers.PATTERN).orderBy("group").collect()
    data = (" " + text).encode()
    assert b"".join(data[r["start"]:r["stop"]] for r in rows) == data and {r["doc_id"] for r in rows} == {5}
    a, b = tokens(both, text)
    assert [i for r in rows for i in r["a"]] == [i for i, _ in a] and [i for r in rows for i in r["b"]] == [i for i, _ in b]


def test_the_quick_form_is_the_tokenizer(both):
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read(), public_tokenizers.PATTERN)
    assert aligner.quick is not None
    r = random.Random(9)
    settled = [c for c in map(chr, range(0x20000)) if not alignment.SETTLED.search(c)]
    for _ in range(400):
        text = "".join(r.choice(settled[:200]) if r.random() < 0.7 else r.choice(settled) for _ in range(r.randrange(1, 80)))
        assert aligner.quick.encode_ordinary(text) == both[0].encode(text, add_special_tokens=False).ids, text
