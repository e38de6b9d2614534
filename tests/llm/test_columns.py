"""Column names that need quotes, through operators that give the other columns back."""

import public_tokenizers

from marketlake.llm import bpe, html, repeats, toxicity


def test_columns_of_any_name(spark):
    rows = [(1, "some text here", 5, "x"), (2, "other text there", 6, "y")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "a.b", "_toxicity"])
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "a.b", "_toxicity", "ids"] and all(len(r["ids"]) >= 3 for r in coded.collect())
    pages = docs.withColumnRenamed("text", "html")
    assert sorted(tuple(r) for r in html.extract(pages).collect()) == [(1, 5, "x", "some text here"), (2, 6, "y", "other text there")]
    left = repeats.without_repeats(docs).select("row.*", "n_bytes").collect()
    assert sorted((r["doc_id"], r["a.b"], r["n_bytes"]) for r in left) == [(1, 5, 14), (2, 6, 16)]


def test_toxicity_stage_replaces_no_column(spark):
    import corpus_pipeline

    rows = [(i, f"clean words number {i}", i, f"own {i}") for i in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "a.b", "_toxicity"])
    kept = corpus_pipeline.toxicity(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["_toxicity"]) for r in kept.collect()} <= {(i, f"own {i}") for i in range(8)}


def test_labels_of_another_kind_are_left_out(spark):
    docs = spark.createDataFrame([(i, "bad awful words" if i % 2 else "good kind words") for i in range(40)], ["doc_id", "text"])
    labels = spark.createDataFrame([(i, 2 if i == 5 else i % 2) for i in range(40)], ["doc_id", "toxic"])
    model = toxicity.fit(docs, labels)
    assert 0 < model.base < 1
