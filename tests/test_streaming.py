"""Batch and stream give the same, over several micro-batches and after a restart."""

import pytest
from pyspark.sql import functions as F

from marketlake import fixtures as fx
from marketlake import lookups
from marketlake.operators import chat, indicators, ledger, matching
from marketlake.streaming import jobs, newest, positions
from marketlake.streaming.runs import drain, read_files


@pytest.fixture()
def parts(spark, tmp_path):
    """Write a table as files in order, a few at a time, and stream them one file per micro-batch."""
    def make(df, order, n=4):
        folder = str(tmp_path / "in")
        rows = df.withColumn("_n", F.ntile(n).over(__import__("pyspark").sql.Window.orderBy(*order))).persist()

        def write(*which):
            for i in which:
                rows.filter(F.col("_n") == i).drop("_n").coalesce(1).write.mode("append").parquet(folder)
        return folder, df.schema, write
    return make


def run(spark, tmp_path, parts, df, order, job):
    """Two runs with a stop in between; the second goes on from the checkpoint."""
    folder, schema, write = parts(df, order)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write(1, 2)
    stream = lambda: job(read_files(spark, folder, schema, files_per_batch=1))
    early = drain(stream(), out, state).count()
    write(3, 4)
    log = drain(stream(), out, state)
    assert log.count() > early
    return log


def positions_of(spark, tmp_path, parts, df, order, opening=None, **kw):
    """Two runs with a stop in between; gives the folder of the positions."""
    folder, schema, write = parts(df, order)
    root, state = str(tmp_path / "root"), str(tmp_path / "state")
    for which in ((1, 2), (3, 4)):
        write(*which)
        jobs.stream_holdings(read_files(spark, folder, schema, files_per_batch=1), root, state, opening, compact=2, **kw).awaitTermination()
    return root


def test_holdings(spark, sf, tmp_path, parts):
    trades = fx.trades(spark, sf)
    root = positions_of(spark, tmp_path, parts, trades, ["timestamp", "id"])
    want = ledger.fold_trades(trades)
    cols = ["user_id", "symbol", "quantity", "average_price"]
    assert sorted(jobs.current_holdings(spark, root).select(cols).collect()) == sorted(want.holdings.select(cols).collect())
    assert {r.id for r in jobs.rejected_trades(spark, root).collect()} == {r.id for r in want.rejected.collect()}


def test_holdings_of_a_hot_position_are_folded_in_blocks(spark, sf, tmp_path, parts):
    """A third of every batch is one position, cut into blocks of 20 trades."""
    trades = fx.hot_trades(spark, sf).limit(600)
    root = positions_of(spark, tmp_path, parts, trades, ["timestamp", "id"], array_rows=30, block_rows=20)
    want = ledger.fold_trades(trades)
    cols = ["user_id", "symbol", "quantity"]
    assert sorted(jobs.current_holdings(spark, root).select(cols).collect()) == sorted(want.holdings.select(cols).collect())
    assert {r.id for r in jobs.rejected_trades(spark, root).collect()} == {r.id for r in want.rejected.collect()}


def test_holdings_with_opening(spark, sf, tmp_path, parts):
    trades, opening = fx.trades(spark, sf), fx.holdings(spark, sf)
    root = positions_of(spark, tmp_path, parts, trades, ["timestamp", "id"], opening)
    want = ledger.fold_trades(trades, opening).holdings
    idle = opening.join(trades.select("user_id", "symbol").distinct(), ["user_id", "symbol"], "left_anti")
    assert idle.count() > 0
    got = jobs.current_holdings(spark, root, opening)
    cols = ["user_id", "symbol", "quantity"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_late_trade_is_rejected_not_lost(spark, sf, tmp_path, parts):
    trades = fx.trades(spark, sf).limit(40).withColumns({"user_id": F.lit(1).cast("bigint"), "symbol": F.lit("S")})
    root = positions_of(spark, tmp_path, parts, trades, [F.col("timestamp").desc()])
    reasons = [r.reason for r in jobs.rejected_trades(spark, root).collect()]
    assert reasons.count("late") == 30


def test_a_batch_of_trades_may_run_again(spark, tmp_path):
    from marketlake.streaming import positions

    def batch(*rows):
        return spark.createDataFrame([(i, 1, "S", kind, n, 2.0 * i, i) for i, kind, n in rows],
                                     "id long, user_id long, symbol string, transaction_type string, quantity long, price double, t long").withColumn(
            "timestamp", F.timestamp_seconds("t"))

    root = str(tmp_path / "root")
    positions.settle(batch((1, "BUY", 5), (2, "SELL", 9)), 0, root)
    for _ in range(2):
        positions.settle(batch((3, "SELL", 5), (1, "BUY", 7), (4, "GIFT", 1)), 1, root)
    positions.settle(batch((5, "BUY", 3)), 2, root)
    assert [(r["quantity"], r["average_price"]) for r in positions.current(spark, root).collect()] == [(3, 10.0)]  # closed, then new
    assert sorted((r["id"], r["reason"]) for r in positions.rejected(spark, root).collect()) == sorted(
        [(2, "Not enough shares to sell"), (1, "late"), (4, ledger.BAD_TYPE)])


def test_indicators(spark, sf, tmp_path, parts):
    bars = fx.bars_events(spark, sf).withColumn("symbol", F.concat(F.lit("s"), F.col("id") % 5)).select("symbol", "date", "close")
    log = run(spark, tmp_path, parts, bars, ["date"], jobs.stream_indicators).filter(~F.col("late"))
    want = indicators.technical_indicators(bars)
    cols = ["macd", "signal_line", "sma_20", "sma_50", "rsi", "bb_middle", "bb_upper", "bb_lower"]
    a = {(r.symbol, r.date): [r[c] for c in cols] for r in log.collect()}
    b = {(r.symbol, r.date): [r[c] for c in cols] for r in want.collect()}
    assert set(a) == set(b)
    for k, values in b.items():
        for x, y in zip(a[k], values):
            assert (x is None or x != x) if y is None else x == pytest.approx(y, rel=1e-9, abs=1e-9)


def quotes_of(spark, tmp_path, parts, df, order, compact=2):
    """Two runs with a stop in between; gives the folder and what has won."""
    folder, schema, write = parts(df, order)
    root, state = str(tmp_path / "root"), str(tmp_path / "state")
    assert jobs.latest_quotes(spark, root, schema).count() == 0  # nothing yet
    for which in ((1, 2), (3, 4)):
        write(*which)
        jobs.stream_latest_quote(read_files(spark, folder, schema, files_per_batch=1), root, state, compact=compact).awaitTermination()
    return root, newest.winners(spark, root, schema)


@pytest.mark.parametrize("compact", [2, 3, 16])
def test_latest_quote(spark, sf, tmp_path, parts, compact):
    quotes = fx.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("source"), F.length("event_type").alias("priority"), F.col("value").alias("price"))
    twice = quotes.unionByName(quotes.sample(0.3, seed=1))
    root, won = quotes_of(spark, tmp_path, parts, twice, [F.hash("ts")], compact)  # in any order
    now = jobs.latest_quotes(spark, root, quotes.schema)
    assert sorted(now.collect()) == sorted(jobs.newest_quotes(quotes).collect())
    emitted = won.collect()
    best = {}
    for r in sorted(emitted, key=lambda r: r["batch"]):  # each is newer than what won before it
        rank = (r["ts"], -r["priority"], r["source"], r["priority"], r["price"])
        assert r["symbol"] not in best or rank > best[r["symbol"]]
        best[r["symbol"]] = rank
    assert len(emitted) < twice.count()


def test_older_or_lesser_quote_never_wins(spark):
    rows = spark.createDataFrame(
        [("A", 5, "x", 1, 1.0), ("A", 9, "y", 2, 2.0), ("A", 9, "x", 1, 3.0), ("A", 1, "x", 0, 4.0)],
        "symbol string, t long, source string, priority int, price double").withColumn("ts", F.timestamp_seconds("t"))
    assert jobs.newest_quotes(rows).first().price == 3.0


def test_a_batch_may_run_again_and_repeats_do_not_win(spark, tmp_path):
    def rows(*quotes):
        return spark.createDataFrame(list(quotes), "symbol string, t long, source string, priority int, price double").withColumn("ts", F.timestamp_seconds("t"))

    root = str(tmp_path / "root")
    first = rows(("A", 5, "x", 1, 1.0), (None, 5, "x", 1, 2.0), ("B", None, "x", 1, 3.0))
    newest.settle(first, 0, root, jobs.QUOTE, 2)
    for _ in range(2):  # the second time as after a failure before the checkpoint
        newest.settle(rows(("A", 5, "x", 1, 1.0), ("A", 4, "x", 0, 9.0), (None, 6, "x", 1, 4.0), ("B", 1, "x", 1, 5.0)), 1, root, jobs.QUOTE, 2)
    newest.settle(rows(("A", 7, "x", 1, 6.0)), 2, root, jobs.QUOTE, 2)
    newest.settle(rows(), 3, root, jobs.QUOTE, 2)
    won = sorted(((r["batch"], r["symbol"], r["price"]) for r in newest.winners(spark, root, first.schema).collect()), key=str)
    assert won == [(0, "A", 1.0), (0, "B", 3.0), (0, None, 2.0), (1, "B", 5.0), (1, None, 4.0), (2, "A", 6.0)]
    assert {(r["symbol"], r["price"]) for r in jobs.latest_quotes(spark, root, first.schema).collect()} == {("A", 6.0), ("B", 5.0), (None, 4.0)}


def test_a_reader_reads_one_row_for_each_symbol(spark, tmp_path):
    """After many batches the state is the base and what won since, not the log."""
    root = str(tmp_path / "root")
    for i in range(9):
        batch = spark.range(300).select(
            F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("symbol"), F.timestamp_seconds(F.lit(i)).alias("ts"),
            F.lit("x").alias("source"), F.lit(1).alias("priority"), F.col("id").cast("double").alias("price"))
        newest.settle(batch, i, root, jobs.QUOTE, 4)
    paths, since = newest._held(spark, root)
    read = sum(spark.read.parquet(p).count() for p in paths)
    symbols = 201
    assert newest.winners(spark, root, batch.schema).count() == 9 * symbols and since <= 4 and read <= (since + 1) * symbols
    assert jobs.latest_quotes(spark, root, batch.schema).count() == symbols


def test_trades_of_a_batch_meet_what_is_held_once(spark, tmp_path, monkeypatch):
    """The fold, the late trades and the ends of a batch read the marked trades; none of them joins again."""
    plans, fold = [], positions.fold_trades
    monkeypatch.setattr(positions, "fold_trades", lambda trades, *a, **k: plans.append(trades._jdf.queryExecution().optimizedPlan().toString()) or fold(trades, *a, **k))
    rows = [(1, 1, "A", "BUY", 5, 2.0, 10), (2, 1, "A", "SELL", 9, 2.0, 20), (3, 1, "A", "BUY", 1, 2.0, 15), (4, 1, "A", "BUY", 2, 2.0, 30)]
    trades = spark.createDataFrame(rows, "id long, user_id long, symbol string, transaction_type string, quantity long, price double, t long").withColumn(
        "timestamp", F.timestamp_seconds("t"))
    root = str(tmp_path / "root")
    positions.settle(trades.filter("id <= 2"), 0, root)
    positions.settle(trades.filter("id > 2"), 1, root)
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    assert [(r.user_id, r.quantity) for r in positions.current(spark, root).collect()] == [(1, 7)]
    assert sorted((r.id, r.reason) for r in positions.rejected(spark, root).collect()) == [(2, lookups.NOT_ENOUGH_SHARES), (3, positions.LATE)]


def test_news(spark, sf, tmp_path, parts):
    news = fx.news(spark, sf).withColumn("published_at", F.timestamp_seconds(F.lit(1704067200) + F.col("arrival") * 60))
    queries = spark.createDataFrame([(1, "the"), (2, "Und"), (3, "license")], "query_id long, query string")
    log = run(spark, tmp_path, parts, news, ["arrival"], lambda s: jobs.stream_news_match(s, queries))
    want = matching.matches(news, ["headline", "summary"], queries, "query_id", "query")
    pair = ["arrival", "query_id"]
    assert sorted(log.select(pair).collect()) == sorted(want.select(pair).collect())


def test_late_articles_and_null_urls_are_kept(spark, tmp_path, parts):
    news = spark.createDataFrame(
        [(i, None if i % 2 else "u", "the news", "s", 1_000_000 - 90_000 * i) for i in range(8)],
        "arrival long, url string, headline string, summary string, t long").withColumn("published_at", F.timestamp_seconds("t"))
    queries = spark.createDataFrame([(1, "the")], "query_id long, query string")
    log = run(spark, tmp_path, parts, news, ["arrival"], lambda s: jobs.stream_news_match(s, queries))
    assert sorted(r.arrival for r in log.collect()) == [0, 1, 3, 5, 7]  # the url once, all those without


def test_each_url_once_for_a_query(spark, tmp_path, parts):
    """Repeats within a file, in a later file and after a restart; another query meets the same urls."""
    news = spark.createDataFrame(
        [(i, None if i % 5 == 0 else f"u{i % 3}", "the news" if i % 2 else "und so", "s", 1_000_000 - 900 * i) for i in range(40)],
        "arrival long, url string, headline string, summary string, t long").withColumn("published_at", F.timestamp_seconds("t"))
    queries = spark.createDataFrame([(1, "the"), (2, "und"), (3, "ne")], "query_id long, query string")
    log = run(spark, tmp_path, parts, news, [F.hash("arrival")], lambda s: jobs.stream_news_match(s, queries)).collect()
    every = matching.matches(news, ["headline", "summary"], queries, "query_id", "query").collect()
    assert sorted((r.query_id, r.url) for r in log if r.url) == sorted({(r.query_id, r.url) for r in every if r.url})
    assert sorted((r.query_id, r.arrival) for r in log if not r.url) == sorted((r.query_id, r.arrival) for r in every if not r.url)


def test_the_only_quote_of_a_symbol_may_be_late(spark, tmp_path, parts):
    quotes = spark.createDataFrame(
        [("A", 900_000 + i, "x", 1, float(i)) for i in range(6)] + [("B", 5, "x", 1, 9.0)] + [("A", 900_005, "y", 0, 7.0)],
        "symbol string, t long, source string, priority int, price double").withColumn("ts", F.timestamp_seconds("t"))
    root, _ = quotes_of(spark, tmp_path, parts, quotes, [F.desc("t")])
    assert {(r.symbol, r.price) for r in jobs.latest_quotes(spark, root, quotes.schema).collect()} == {("A", 7.0), ("B", 9.0)}


def test_chat_context(spark, sf, tmp_path, parts):
    msgs = fx.chat_messages(spark, sf)
    log = run(spark, tmp_path, parts, msgs, ["timestamp", "id"], jobs.stream_chat_context)
    assert {r.id: r.context for r in log.collect()} == {r.id: r.context for r in chat.chat_context(msgs).collect()}
