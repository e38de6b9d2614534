"""The pipeline against plain versions of its stages, each on what the one before kept."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import test_exact
import test_minhash
from tokenizers import Tokenizer

import corpus_pipeline
from marketlake import session
from marketlake.llm import queries, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeats(rows, length=200):
    seen = defaultdict(int)
    texts = [(t or "").encode() for _, t in rows]
    for d in texts:
        for i in range(len(d) - length + 1):
            seen[hash(d[i:i + length])] += 1
    for (doc, _), d in zip(rows, texts):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i:i + length])] > 1:
                gone[i:i + length] = True
        parts, at = [], 0
        for end in [*np.flatnonzero(np.diff(gone)) + 1, len(d)]:
            if at < end and not gone[at]:
                parts.append(d[at:end].decode("utf-8", "ignore"))
            at = end
        yield doc, "".join(parts)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.toxicity_model(spark, sf, docs)
    rows = [(d.doc_id, d.text) for d in docs.collect() if model.score(model.sentences(d.text or "", {})) < 0.3]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "stage")
        assert docs.columns == COLUMNS
        if name == "exact dedup":
            keep = {w[0] for w in test_exact.brute(rows) if w[3]}
            rows = [x for x in rows if x[0] in keep]
        if name == "near dedup":
            keep = {w[0] for w in test_minhash.brute(rows) if w[3]}
            rows = [x for x in rows if x[0] in keep]
        if name == "suffix-array dedup":
            rows = list(without_repeats(rows))
            assert {d.doc_id: d.n_chars for d in docs.collect()} == {i: len(t) for i, t in rows}
        assert sorted((d.doc_id, d.text) for d in docs.collect()) == sorted(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    tokenizer, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want += [(doc, i, zlib.crc32(ids[i * 2048:(i + 1) * 2048].tobytes())) for i in range(-(-len(ids) // 2048))]
    assert sorted((x.doc_id, x.piece, x.ids_crc32) for x in packed) == sorted(want)
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted((x.doc_id, x.piece, x.ids_crc32) for x in again) == sorted(want)


def test_stages_keep_clean_documents_and_survive_odd_ones(spark, sf, monkeypatch):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "alone here", "en", "s", 3), (3, "clean words only", "en", None, 1),
            (3, "clean words only", "en", None, 1), (4, "é" * 50_000, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(queries, "toxicity_model", lambda *a: toxicity.Model({}, -2.0, 0.01))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "odd")
    left = sorted((d.doc_id or 0) for d in docs.collect())
    assert left == [0, 1, 3, 4]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("at", range(5))
def test_names(at):
    assert [n for n, _ in corpus_pipeline.STAGES][at] == ["toxicity", "exact dedup", "near dedup", "suffix-array dedup", "best-fit packing"][at]


def test_stages_hand_over_batches_of_bounded_size(spark, sf):
    """Rows of sets and texts are long: ten thousand of them, Spark's default, took most of an executor's memory."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(i, "word " * 50_000) for i in range(60)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    corpus_pipeline.near_dedup(spark, docs, sf)
    found = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
    assert len(found) > 1 and max(found) < session.BATCH + 300_000
