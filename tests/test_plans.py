"""What the physical plans look like, and that skew does not change results."""

import pytest
from pyspark.sql import functions as F

from marketlake import fixtures as fx
from marketlake.operators import chat, groups, indicators, ledger, matching
from marketlake.operators import relational as rel


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block,sorts,windows", [(None, 1, 3), (1300, 2, 6)])
def test_indicators_take_one_exchange(spark, block, sorts, windows):
    rows = spark.range(3_000).select(
        (F.col("id") % 2).cast("string").alias("symbol"), F.timestamp_seconds("id").alias("date"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("close"))
    text = plan(indicators.technical_indicators(rows, block=block))
    assert text.count("Exchange hashpartitioning") == 1
    assert (text.count("Sort ["), text.count("Window [")) == (sorts, windows)
    assert "Python" not in text


def test_only_needed_columns_are_read(spark, sf):
    text = plan(indicators.sma(fx.bars_events(spark, sf).select("symbol", "date", "close")))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text


@pytest.mark.parametrize("make", [
    lambda s, d: rel.recent_trades(fx.trades(s, d)),
    lambda s, d: rel.history(fx.bars_events(s, d)),
    lambda s, d: rel.news_top(fx.news(s, d), 10, ["source"]),
    lambda s, d: matching.news_search(fx.news(s, d), s.createDataFrame([(1, "the")], "query_id long, query string")),
])
def test_top_k_is_cut_before_the_exchange(spark, sf, make):
    text = plan(make(spark, sf))
    below = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_global_top_k(spark, sf):
    assert "TakeOrderedAndProject" in plan(rel.news_top(fx.news(spark, sf)))


def test_filters_reach_the_scan(spark, sf):
    recent = rel.trailing_days(fx.table(spark, sf, "events").select("ts", "value"), "ts", "2024-01-15", 7)
    pushed = plan(recent).split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(ts,2024-01-08" in pushed and "LessThan(ts,2024-01-16" in pushed
    held = fx.table(spark, sf, "events").select("user_id", F.lit("s").alias("symbol"), F.lit(1).alias("quantity"),
                                                F.col("value").alias("average_price"), F.col("ts").alias("last_updated"))
    assert "PushedFilters: [In(user_id" in plan(rel.holdings_for(held, [3, 4]))


def test_no_nested_loops_or_products(spark, sf):
    rules = spark.createDataFrame([(1, "the", "x")], "priority long, keyword string, tag string")
    for df in (matching.match_rules(fx.news(spark, sf), "summary", rules), chat.chat_context(fx.chat_messages(spark, sf)),
               ledger.fold_trades(fx.trades(spark, sf)).holdings):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_places_are_exact_ranks(spark):
    rows = spark.range(5_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("k"),
        (F.col("id") * 7919 % 5_000).alias("o"))
    got = groups.with_places(rows.repartition(6), ["k"], [F.col("o")], 5_000, task_rows=400)
    want = sorted((r.k, r.o) for r in rows.collect())
    assert [(r.k, r.o) for r in sorted(got.collect(), key=lambda r: r["_place"])] == want
    assert sorted(r["_place"] for r in got.collect()) == list(range(5_000))


def test_a_hot_key_spreads_over_blocks(spark):
    rows = spark.range(3_000).select(F.lit("hot").alias("symbol"), F.col("id").alias("date"), F.col("id").cast("double").alias("close"))
    sizes = []

    def look(df, group, order, longest):
        sizes.append((df.groupBy(*group).count().agg(F.max("count")).first()[0], longest))
        return df

    done = groups.by_group(rows, ["symbol"], [F.col("date")], look, 10, hot_rows=100, block_rows=200)
    assert done.count() == 3_000
    most, said = sizes[-1]
    assert most <= said == 210


def test_skewed_join_is_split(spark):
    """A third of the left rows on one key: adaptive execution cuts that partition."""
    keep = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
        "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        left = spark.range(200_000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("symbol"), "id")
        quotes = left.select("symbol").distinct().withColumns({
            "price": F.lit(1.0), "change": F.lit(1.0), "change_percent": F.lit(1.0)})
        joined = rel.enrich_quotes(left, quotes.repartition(4))
        assert joined.agg(F.count("*")).first()[0] == 200_000
        joined.write.format("noop").mode("overwrite").save()
        done = joined.agg(F.sum("price"))
        done.collect()
        assert "skew=true" in plan(done)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
