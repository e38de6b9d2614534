"""Packing: every id has its place, sequences are gapless, and few; ids against the tokenizer on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marketlake.llm import packing
from marketlake.llm.queries import QUERIES

PATH = P.path("word_bpe_49k.json")


def first_fit_decreasing(sizes, capacity):
    gaps = []
    for size in sorted(sizes, reverse=True):
        best = min((g for g in gaps if g >= size), default=None)
        if best is None:
            gaps.append(capacity - size)
        else:
            gaps[gaps.index(best)] -= size
    return len(gaps)


def sequences(rows):
    """Rows of (size, sequence, offset): checks that they lie side by side, gives the number of sequences."""
    by = defaultdict(list)
    for size, seq, offset in rows:
        by[seq].append((offset, size))
    for found in by.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at <= CAPACITY
    return len(by)


CAPACITY = 200
r = random.Random(7)
CASES = {
    "none": [], "one": [200], "all full": [200] * 30, "halves": [100] * 61, "over half": [101] * 40,
    "ones": [1] * 1_000, "thirds": [66, 67] * 90, "uniform": [r.randint(1, 200) for _ in range(1_500)],
    "small": [min(200, int(r.expovariate(1 / 25)) + 1) for _ in range(2_000)],
    "large": [r.randint(70, 200) for _ in range(800)], "hot size": [37] * 900 + [r.randint(1, 200) for _ in range(300)],
}


@pytest.mark.parametrize("case", CASES)
def test_few_sequences(spark, case, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 150)
    sizes = CASES[case]
    table = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    got = packing.pack(table, CAPACITY).collect()
    assert sorted(x.uid for x in got) == list(range(len(sizes)))
    used = sequences([(sizes[x.uid], x.sequence_id, x.offset) for x in got])
    assert used <= first_fit_decreasing(sizes, CAPACITY) * 1.03 + 1


def test_what_fits_into_one_range_takes_one_sweep(spark, monkeypatch):
    sweeps = []

    def stored(df, label):
        sweeps.append(label)
        return own(df, label)

    own = packing.stored
    monkeypatch.setattr(packing, "stored", stored)
    sizes = CASES["large"] + CASES["small"]
    got = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "uid long, length long"), CAPACITY).collect()
    assert sweeps == ["swept"]
    assert sequences([(sizes[x.uid], x.sequence_id, x.offset) for x in got]) == first_fit_decreasing(sizes, CAPACITY)


def test_chunks_are_learned_once_for_a_batch(monkeypatch):
    chunks, learned = packing._Chunks(open(PATH, encoding="utf-8").read()), []
    learn = chunks._learn
    monkeypatch.setattr(chunks, "_learn", lambda new: learned.extend(new) or learn(new))
    texts = pa.array(["one two. two", "", "two three", "one\u0301 three"])
    first, again = ([x.tolist() for x in chunks.ids_of(texts)] for _ in range(2))
    assert first == again == [chunks.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert learned.count("two") == 1 and learned.count("one") == 2  # what came once is not remembered


def test_query(spark, sf):
    tokenizer = Tokenizer.from_file(PATH)
    got = QUERIES["op3_best_fit_packing"](spark, sf).collect()
    pieces = defaultdict(list)
    for x in got:
        pieces[x.doc_id].append(x)
    texts = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(pieces) == set(texts)
    total = 0
    for doc, found in pieces.items():
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        found.sort(key=lambda x: x.piece)
        assert [x.piece for x in found] == list(range(-(-len(ids) // 2048)))
        for x in found:
            part = ids[x.piece * 2048:(x.piece + 1) * 2048]
            assert (x.start, x.length, x.ids_crc32) == (x.piece * 2048, len(part), zlib.crc32(part.tobytes()))
    by = defaultdict(int)
    for x in got:
        by[x.sequence_id] += x.length
        assert x.offset + x.length <= 2048
    starts = {(x.sequence_id, x.offset) for x in got}
    assert all((x.sequence_id, x.offset + x.length) in starts or by[x.sequence_id] == x.offset + x.length for x in got)
    assert len(by) <= -(-total // 2048) + 2


@pytest.mark.parametrize("text", [
    "", " ", "a b c\x85d", "é ́x à", "Iİ ΣΣ ẞ", "it's we're'll 12 345", "x\x1cy \x0b\x0cz",
    "<|endoftext|>a<|startoftext|> b", "中文字 \U0001f600\U0001f600", "no" * 400, "\n\t\r  tab\tand\nline\r\n",
    " ̸=", "한글 한"])
def test_chunks_are_as_whole_texts(text):
    source = open(PATH, encoding="utf-8").read()
    assert packing._Chunks(source).ids(text) == Tokenizer.from_str(source).encode(text, add_special_tokens=False).ids


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 5_000, None), (3, "same", 4), (3, "same", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = packing.pack_documents(docs, PATH).collect()
    assert sorted((x.doc_id or 0, x.piece, x.length) for x in got) == [
        (0, 0, 1), (1, 0, 1), (1, 0, 1), (2, 0, 2048), (2, 1, 2048), (2, 2, 905), (3, 0, 2), (3, 0, 2)]
    assert len({(x.sequence_id, x.offset) for x in got}) == len(got)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    ids = packing.pieces(docs, PATH, with_ids=True).filter("doc_id = 3").first().ids
    assert ids == Tokenizer.from_file(PATH).encode("same", add_special_tokens=False).ids + [0]
