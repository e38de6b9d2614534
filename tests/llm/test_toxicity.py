"""Toxicity: held-out accuracy, the sentences found, the gradient, and odd tables."""

import random
import zlib

import numpy as np
import pytest

from marketlake.llm import toxicity
from marketlake.llm.queries import QUERIES

WORDS = [f"{a}{b}" for a in ("lor", "ips", "dol", "ame", "con", "sed") for b in ("em", "um", "or", "it", "es", "ing", "ar")]


def corpus(n, seed):
    r = random.Random(seed)
    for i in range(n):
        sentences = [" ".join(r.choice(WORDS) for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            sentences[r.randrange(len(sentences))] += " " + r.choice(["you blockhead", "such nastyling", "nastylich ones"])
        yield i, ". ".join(sentences) + ".", int(toxic)


@pytest.fixture(scope="module")
def model(spark):
    rows = list(corpus(600, 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_learns_from_documents_and_finds_sentences(spark, model):
    rows = list(corpus(300, 2))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    scored = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all((scored[i].score >= 0.3) == bool(y) for i, _, y in rows)
    found = toxicity.offending(docs, model).collect()
    assert {x.doc_id for x in found} == {i for i, _, y in rows if y}
    assert all(("blockhead" in x.sentence or "nasty" in x.sentence) and scored[x.doc_id].text[x.start:x.stop] == x.sentence for x in found)


def test_gradient_is_that_of_the_noisy_or():
    """A step lowers the loss, and a bag is toxic by one sentence alone."""
    bags, y = [[[0], [1]], [[1]], [[1], [2]], [[0, 2]]] * 20, np.array([1, 0, 0, 1] * 20)
    w, bias, base = toxicity._trained(y, bags, 3)
    p = 1 / (1 + np.exp(-(bias + w)))
    assert p[0] > 0.9 and p[1] < 0.1 and p[2] < 0.1 and 0 < base < 0.2


def test_held_out_accuracy(spark, sf):
    bigger = sf.replace("sf0.001", "sf0.1")
    got = {x.doc_id: x for x in QUERIES["op2_toxicity"](spark, bigger).collect()}
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{bigger}/labels.parquet").collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and x.predicted == int(x.score >= 0.3) and 0 <= x.score <= 1
               for i, x in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if i in got and got[i].held_out]
    hit = sum(p and y for p, y in held)
    assert hit >= 0.8 * sum(y for _, y in held) and hit >= 0.85 * sum(p for p, _ in held)


def test_odd_tables(spark, model):
    rows = [(None, None), (1, ""), (1, ""), (2, "lorem " * 50_000), (3, "\n...\n!"), (4, "a blockhead\nblockhead"), (5, "É" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.score) for x in toxicity.score(docs, model).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for _, s in got)
    assert [i for i, s in got if s >= 0.3] == [4]
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not nothing.weights and all(x.score == pytest.approx(nothing.base) for x in toxicity.score(docs, nothing).collect())
