import random

import pytest
from pyspark.sql import functions as F

from marketlake import lookups
from marketlake.functions import scalars as fn
from marketlake.functions import text as txt
from marketlake.operators import matching


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.o for r in rows.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_sentiment_bullish_wins(spark):
    texts = ["BULLISH and bearish", "a bearISH day", "calm", "", None]
    assert column(spark, texts, txt.sentiment_tag) == ["Bullish", "Bearish", "Neutral", "Neutral", "Neutral"]


def test_faq_takes_the_first_in_list_order(spark):
    text = "what is a dividend and What Is A Stock"
    assert column(spark, [text, "x"], lambda c: txt.faq_answer(c, lookups.FAQ, "none")) == [dict(lookups.FAQ)["what is a stock"], "none"]


def test_topics_repeat_and_default_to_all(spark):
    got = column(spark, ["Apple and Tesla stock", "weather", "TECH market"], txt.topic_tags)
    assert got == [["companies", "companies", "markets"], lookups.TOPICS, ["markets", "technology"]]


def test_percentages(spark):
    assert column(spark, ["1.5%", "0%", "-1.25%", "", "%", "a%"], fn.pct_to_double) == [1.5, 0.0, -1.25, None, None, None]
    assert column(spark, ["1.5%%", "%1"], fn.trailing_pct_to_double) == [1.5, None]


def test_truncate_counts_characters(spark):
    got = column(spark, ["é" * 5, "é" * 6, "𝛼" * 6], lambda c: fn.truncate_ellipsis(c, 5))
    assert got == ["é" * 5, "é" * 5 + "...", "𝛼" * 5 + "..."]


def test_checksum(spark):
    words = ["AAPL", "", "Zé"]
    assert column(spark, words, fn.symbol_checksum) == [sum(map(ord, w)) for w in words]


def test_default_only_for_absent_keys(spark):
    rows = spark.createDataFrame([({"a": "1"},), ({"a": None},), ({},)], "m map<string,string>")
    got = [r.o for r in rows.select(fn.default_if_missing(F.col("m"), "a", "d").alias("o")).collect()]
    assert sorted(got, key=str) == ["1", None, "d"]


def test_iso_drops_a_zero_fraction(spark):
    rows = spark.sql("SELECT timestamp'2024-01-02 03:04:05' a, timestamp'2024-01-02 03:04:05.000120' b")
    r = rows.select(fn.iso_timestamp(F.col("a")), fn.iso_timestamp(F.col("b"))).first()
    assert tuple(r) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000120")


def news(spark, n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Gamma", "ab", "bab", "aba", "%_", "a.b", "straße", ""]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k)) if rng.random() > 0.05 else None
    return [(i, text(3), text(12)) for i in range(n)]


def brute(rows, queries, k):
    out = set()
    for q, word in queries:
        hits = [a for a, h, s in sorted(rows) if word.lower() in (h or "").lower() or word.lower() in (s or "").lower()]
        out |= {(q, a, i + 1) for i, a in enumerate(hits[:k])}
    return out


@pytest.mark.parametrize("kw", [{}, {"few": 2}, {"few": 2, "broadcast_bytes": 0}])
def test_news_search_equals_brute_force(spark, kw):
    rows = news(spark, 300, 1)
    queries = [(1, "BETA"), (2, "aba"), (3, "%_"), (4, "a.b"), (5, "ß"), (6, "absent"), (7, ""), (8, "ta ga"), (9, "b"), (10, "b")]
    df = spark.createDataFrame(rows, "arrival long, headline string, summary string").repartition(5)
    found = matching.news_search(df, spark.createDataFrame(queries, "query_id long, query string"), 10, **kw)
    assert {(r.query_id, r.arrival, r["rank"]) for r in found.collect()} == brute(rows, queries, 10)


def test_a_match_does_not_span_headline_and_summary(spark):
    df = spark.createDataFrame([(1, "foo", "bar")], "arrival long, headline string, summary string")
    for kw in ({}, {"few": 0}, {"few": 0, "broadcast_bytes": 0}):
        found = matching.news_search(df, spark.createDataFrame([(1, "foobar"), (2, "oba")], "query_id long, query string"), **kw)
        assert found.count() == 0


def test_plan_of_few_patterns(spark, sf):
    from marketlake import fixtures as fx
    few = spark.createDataFrame([(1, "the"), (2, "und")], "k long, p string").repartition(2)
    text = matching.matches(fx.news(spark, sf), ["headline", "summary"], few, "k", "p")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Python" not in text and sum("documents.parquet" in line for line in text.splitlines()) == 1


def test_stream_of_few_patterns(spark, tmp_path):
    """A stream's texts are tested with the few patterns as they are: no row for each gram of a text."""
    texts = spark.createDataFrame([(1, "The news"), (2, None), (3, "und so")], "id long, t string")
    texts.write.parquet(str(tmp_path / "texts"))
    table = spark.createDataFrame([(1, "THE"), (2, "o"), (3, ""), (4, None)], "k long, p string").repartition(2)
    found = matching.matches(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "texts")), ["t"], table, "k", "p")
    assert "_gram" not in found._jdf.queryExecution().analyzed().toString()
    query = found.writeStream.format("memory").queryName("few_patterns").trigger(availableNow=True).start()
    query.awaitTermination()
    want = matching.matches(texts, ["t"], table, "k", "p")
    assert sorted(spark.table("few_patterns").select("id", "k").collect()) == sorted(want.select("id", "k").collect()) == [(1, 1), (1, 3), (2, 3), (3, 2), (3, 3)]


def test_plan_of_many_patterns(spark, sf):
    """One scan of the texts, nothing in Python, texts not shuffled, grams looked up before the texts are tested."""
    from marketlake import fixtures as fx
    words = spark.range(3_000).select(F.col("id").alias("k"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("p"))
    found = matching.matches(fx.news(spark, sf), ["headline", "summary"], words, "k", "p")
    text = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "documents.parquet" in line]
    assert len(scans) == 1 and "Python" not in text and "Arrow" not in text and "NestedLoop" not in text
    assert "BroadcastHashJoin [_gram" in text and "Generate explode" in text


@pytest.mark.parametrize("n", [64, 20_000, 300_000])
def test_any_number_of_patterns(spark, sf, n):
    """The patterns are pieces of the texts, pieces that are nowhere, and a few that nearly every text holds."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("arrival"), "text").orderBy("arrival").limit(40)
    texts = {r["arrival"]: r["text"].lower() for r in docs.collect()}
    rng = random.Random(n)
    every = list(texts.values())
    patterns = ["the", "e", "", "ß", " "]
    while len(patterns) < n:
        text = rng.choice(every)
        at = rng.randrange(len(text))
        piece = text[at:at + rng.randrange(1, 12)]
        patterns.append(piece if rng.random() < 0.2 else piece + f"@{len(patterns)}")
    table = spark.createDataFrame(list(enumerate(patterns)), "k long, p string")
    found = {(r["arrival"], r["k"]) for r in matching.matches(docs, ["text"], table, "k", "p").select("arrival", "k").collect()}
    plain = [(k, p) for k, p in enumerate(patterns) if "@" not in p]
    want = {(a, k) for a, t in texts.items() for k, p in plain if p in t}
    odd = [(k, p) for k, p in enumerate(patterns) if "@" in p]
    assert {x for x in found if "@" not in patterns[x[1]]} == want
    sample = rng.sample(odd, min(len(odd), 2_000))
    assert {x for x in found if "@" in patterns[x[1]]} >= {(a, k) for a, t in texts.items() for k, p in sample if p in t}
    assert all(patterns[k] in texts[a] for a, k in found)


def test_columns_and_odd_texts_stay(spark):
    rows = [(1, "a\nb😀c", 5, "x"), (2, None, 6, "y"), (3, "", 7, "z"), (3, "", 7, "z")]
    df = spark.createDataFrame(rows, "id long, `a.b` string, k long, text string").withColumnRenamed("a.b", "t")
    table = spark.createDataFrame([(1, "a\nb"), (2, "😀c"), (3, ""), (4, None), (5, "b😀c"), (6, "zz")], "k long, p string")
    for kw in ({}, {"few": 0}, {"few": 0, "broadcast_bytes": 0}):
        found = matching.matches(df, ["t"], table, "k", "p", **kw)
        assert found.columns == ["id", "t", "text", "k"]
        assert sorted((r["id"], r["k"]) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 3), (3, 3), (3, 3)]
    empty = table.filter("k > 100")
    assert matching.matches(df, ["t"], empty, "k", "p").count() == 0
    assert matching.matches(df.limit(0), ["t"], table, "k", "p").count() == 0
