"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Only documents have labels. A sentence's score is a logistic function of the features of its words (the word, and its
beginnings of four to seven letters, as insults are inflected); a document's is the noisy-or of its
sentences: one minus the product of all ``1 - score``. The weights are trained through the noisy-or from the labels of
documents, and then say which sentences offend.

The model is fitted on a bounded sample of labelled documents (``SAMPLE``); its features, at most ``FEATURES``, are those
that toxic documents of the sample hold clearly more often. All documents are scored on their whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.llm.common import by_place, freeing, whole
from marketlake.session import stored

SAMPLE = 20_000  # labelled documents that the model is fitted on, at most
FEATURES = 20_000  # features of the model, at most
LEAST = 4  # toxic documents of the sample that a feature must be in
LIFT = 4.0  # times as often in toxic documents as in others
STEPS = 300
RIDGE = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in range(4, 8) if len(word) >= n)]


@dataclass
class Model:
    """``score = 1 - (1 - base) * prod(1 - sigmoid(bias + weights))`` over the sentences with known features."""

    weights: dict[str, float]
    bias: float
    base: float

    def word(self, word: str) -> float | None:
        found = [self.weights[f] for f in features_of(word) if f in self.weights]
        return sum(found) if found else None

    def sentences(self, text: str, known: dict[str, float | None]) -> list[tuple[int, int, float]]:
        """Start, end and score of the sentences with known features."""
        out = []
        if not any(self._look(w, known) is not None for w in set(_WORD.findall(text.lower()))):
            return out
        for m in _SENTENCE.finditer(text):
            found = [x for w in set(_WORD.findall(m[0].lower())) if (x := self._look(w, known)) is not None]
            if found:
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-np.clip(self.bias + sum(found), -30, 30)))))
        return out

    def _look(self, word: str, known: dict[str, float | None]) -> float | None:
        if word not in known:
            if len(known) >= 300_000:
                known.clear()
            known[word] = self.word(word)
        return known[word]

    def score(self, found: list[tuple[int, int, float]]) -> float:
        return float(1 - (1 - self.base) * np.prod([1 - p for *_, p in found]))


def _toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch["text"]:
            counts.update({f for w in set(_WORD.findall(text.as_py().lower())) for f in features_of(w)})
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["feature", "n"])


def _counts(candidates: dict[str, int]):
    """In how many documents of each label a candidate is, summed for each batch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for label, text in zip(batch["label"].to_pylist(), batch["text"]):
                words = set(_WORD.findall(text.as_py().lower()))
                counts.update((label, candidates[f]) for f in {f for w in words for f in features_of(w) if f in candidates})
            label, feature = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), pa.array(label, pa.int32()), pa.array(counts.values(), pa.int64())],
                                             names=["feature", "label", "n"])
    return work


def _instances(candidates: dict[str, int]):
    """Each document as the candidate features of its sentences; sentences without any are left out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = []
                lowered = text.as_py().lower()
                for m in _SENTENCE.finditer(lowered):
                    ids = {candidates[f] for w in set(_WORD.findall(m[0])) for f in features_of(w) if f in candidates}
                    if ids:
                        found.append(sorted(ids))
                rows.append(found)
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(rows, pa.list_(pa.list_(pa.int32())))], names=["label", "sentences"])
    return work


def _trained(labels: np.ndarray, bags: list[list[list[int]]], n_features: int) -> tuple[np.ndarray, float, float]:
    """Weights, bias and base rate by gradient steps on the noisy-or likelihood with a ridge."""
    item = np.array([f for bag in bags for s in bag for f in s], np.int64)
    of = np.repeat(np.arange(sum(map(len, bags))), np.array([len(s) for bag in bags for s in bag], np.int64))
    doc = np.repeat(np.arange(len(bags)), np.array(list(map(len, bags)), np.int64))
    empty = np.array([not bag for bag in bags], bool)
    base = float(np.clip((labels[empty].sum() + 0.1) / (empty.sum() + 10), 1e-4, 0.2))
    w, bias = np.zeros(n_features), -2.0
    gathered, gathered_bias = np.full(n_features, 1e-8), 1e-8
    n = max(1, len(bags))
    for _ in range(STEPS):
        z = np.clip(bias + np.bincount(of, w[item], len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = (1 - base) * np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)))
        slope = np.where(labels[doc] == 1, -p * clean[doc] / np.maximum(1 - clean[doc], 1e-9), p)
        g = np.bincount(item, slope[of], n_features) / n + RIDGE * w / n
        g_bias = slope.sum() / n
        gathered += g**2
        gathered_bias += g_bias**2
        w -= 0.5 * g / np.sqrt(gathered)
        bias -= 0.2 * g_bias / np.sqrt(gathered_bias)
    return w, float(bias), base


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """A model from the labelled documents that come first by a hash of their id, ``sample`` of them at most.

    A document that is labelled twice counts as toxic if one label says so; null ids and labels other than 0 and 1 are left out. Without
    toxic labels the model knows no features.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    rows = stored(texts.join(F.broadcast(chosen), "doc_id").select("label", "text"), "sample")  # ``sample`` rows of two numbers
    counts = (rows.filter("label = 1").select("text").mapInArrow(_toxic_features, "feature string, n long")
              .groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
              .orderBy(F.desc("n"), "feature").limit(5 * FEATURES).collect())
    candidates = {r.feature: i for i, r in enumerate(counts)}
    per_label = rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    n = np.ones(2)
    for r in per_label:
        n[r.label] += r.n
    # At most two numbers for each candidate.
    seen = np.zeros((2, len(candidates)))
    summed = (rows.select("label", "text").mapInArrow(_counts(candidates), "feature int, label int, n long")
              .groupBy("feature", "label").agg(F.sum("n").alias("n")).toArrow())
    seen[summed["label"].to_numpy(), summed["feature"].to_numpy()] = summed["n"].to_numpy()
    lift = ((seen[1] + 0.1) / n[1]) / ((seen[0] + 0.5) / n[0])
    good = np.flatnonzero((lift >= LIFT) & (seen[1] >= LEAST))
    good = np.sort(good[np.argsort(-lift[good] * seen[1][good], kind="stable")[:FEATURES]])
    names = list(candidates)
    chosen_features = {names[f]: i for i, f in enumerate(good.tolist())}
    # Of each sampled document the few chosen features come to the driver.
    found = rows.select("label", "text").mapInArrow(_instances(chosen_features), "label int, sentences array<array<int>>").toArrow()
    y = np.array(found["label"].to_pylist(), np.int64)
    weights, bias, base = _trained(y, found["sentences"].to_pylist(), len(good))
    return Model({name: float(weights[i]) for name, i in chosen_features.items()}, bias, base)


def _shipped(docs: DataFrame, model: Model):
    """The model for the workers: FEATURES words and numbers at most."""
    return docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.base))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; null and empty texts have the base rate. No shuffle.

    A column that has the name of the result is replaced.
    """
    rest = [f for f in docs.schema if f.name != score_col]
    names = [text_col, *(f.name for f in rest if f.name != text_col)]
    places = [names.index(f.name) for f in rest]
    shipped = _shipped(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Model(*shipped.value), {}
        for batch in batches:
            scores = [own.score(own.sentences(t.as_py() or "", known)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at) for at in places), pa.array(scores, pa.float64())],
                                             names=[*(f.name for f in rest), score_col])

    return by_place(docs, names).mapInArrow(freeing(work), T.StructType([*rest, T.StructField(score_col, T.DoubleType())]))


def offending(docs: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, stop, score, sentence``: the sentences that score ``least`` or more, with their places."""
    shipped = _shipped(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Model(*shipped.value), {}
        for batch in batches:
            rows = [(i, a, b, float(p), text[a:b]) for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())
                    for a, b, p in own.sentences(text, known) if p >= least]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 5, kinds)],
                                             names=["doc_id", "start", "stop", "score", "sentence"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return texts.mapInArrow(work, "doc_id long, start long, stop long, score double, sentence string")
