"""BPE against the tiktoken library: tables, every character, long pieces, appends, edits."""

import base64
import hashlib
import random
import sys

import public_tokenizers as P
import pytest
import tiktoken

from marketlake.llm import bpe
from marketlake.llm.queries import QUERIES

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    lines = open(P.path(request.param), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Encoder(lines, P.PATTERN), theirs


def test_every_character(pair):
    ours, theirs = pair
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 4_096):
        text = "a".join(every[at:at + 4_096])
        assert ours.ids(text) == theirs.encode_ordinary(text)


def test_every_token_and_pairs_of_tokens(pair):
    ours, theirs = pair
    r, v = random.Random(1), ours.vocabulary
    for token in r.sample(range(len(v.tokens)), 1_500):
        data = v.tokens[token]
        assert list(v.encode(data)) == theirs._encode_single_piece(data)
        data += v.tokens[r.randrange(len(v.tokens))]
        assert list(v.encode(data)) == theirs._encode_single_piece(data)


@pytest.mark.parametrize("alphabet", ["ab", "the rain", "éèüß", "0123", " \n\t", "中文字日本", "aA!'s 9é\n😀"])
def test_random_texts(pair, alphabet):
    ours, theirs = pair
    r = random.Random(2)
    for n in (0, 1, 2, 5, 40, 300):
        text = "".join(r.choice(alphabet) for _ in range(n))
        assert ours.ids(text) == theirs.encode_ordinary(text)


def test_append_gives_every_prefix(pair):
    ours, theirs = pair
    data = ("unbelievableness" * 3 + "ßüé" + "aaaaaaaaaaaaaaaa").encode()
    grown = bpe.Prefixes(ours.vocabulary)
    for i, byte in enumerate(data):
        grown.append(bytes([byte]))
        want = theirs._encode_single_piece(data[:i + 1])
        if data[:i + 1] not in ours.vocabulary.ranks:  # such a piece is one token by rule
            assert list(grown.ids()) == want
    assert [grown.ids(n) for n in range(len(data))] == [bpe.Prefixes(ours.vocabulary, data[:n]).ids() for n in range(len(data))]


def test_edit_works_out_little_again(pair):
    ours, _ = pair
    r = random.Random(3)
    words = b"".join(r.choice([b"tion", b"er", b"walk", b"ing", b"un", b"x"]) for _ in range(500))
    for _ in range(30):
        p = bpe.Prefixes(ours.vocabulary, words)
        start = r.randrange(len(words))
        stop = min(len(words), start + r.randint(0, 5))
        new = bytes(r.choice(b"abcdefgh") for _ in range(r.randint(0, 6)))
        again = p.replace(start, stop, new)
        fresh = bpe.Prefixes(ours.vocabulary, words[:start] + new + words[stop:])
        assert (p.data, p.last) == (fresh.data, fresh.last)
        assert again <= len(new) + 4 * ours.vocabulary.longest


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_query_against_the_library(spark, sf):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(FILES[0]), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = theirs.encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(theirs.decode_bytes(ids))))
    assert sorted(map(tuple, QUERIES["op8_byte_bpe"](spark, sf).collect())) == sorted(want)


def test_odd_tables(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "a" * 200_000, None), (3, "é 😀\n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(docs, P.path(FILES[0]), P.PATTERN), P.path(FILES[0]))
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got.collect()) == sorted(
        (i or 0, (t or "").encode()) for i, t, _ in rows)
    assert bpe.encode(docs.limit(0), P.path(FILES[0]), P.PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(nothing, P.path(FILES[0])).collect()[0].decoded is None


def test_what_is_remembered_is_bounded(pair, monkeypatch):
    monkeypatch.setattr(sys.modules["marketlake.llm.bpe"], "REMEMBERED", 50)
    lines = open(P.path(FILES[0]), "rb").read()
    ours, (full, _) = bpe.Encoder(lines, P.PATTERN), pair
    r = random.Random(5)
    for _ in range(60):
        text = " ".join("".join(r.choice("abcdef") for _ in range(7)) for _ in range(20))
        ours.ids(text)
        assert len(ours._known) <= 50 + 40 and len(ours.vocabulary.pairs) <= 50


def test_many_texts_learn_a_piece_once(pair, monkeypatch):
    ours, theirs = pair
    texts = [" zzqyx b", "", " zzqyx b zzqyx", "zzqyx 1\n", "😀é"] * 2
    learned, learn = [], ours._learn
    monkeypatch.setattr(ours, "_learn", lambda new: learned.extend(new) or learn(new))
    assert [x.tolist() for x in ours.ids_of(texts)] == [theirs.encode_ordinary(t) for t in texts]
    assert learned.count(" zzqyx") == 1
    assert [x.tolist() for x in ours.ids_of(texts, 5)] == [theirs.encode_ordinary(t) for t in texts]
    assert learned.count(" zzqyx") == 1
