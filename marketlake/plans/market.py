"""Bars, indicators, quotes and symbol search."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake import fixtures as fx
from marketlake import lookups
from marketlake.operators import indicators as ind
from marketlake.operators import relational as rel
from marketlake.plans.registry import query, r6, shown, six
from marketlake.plans.views import sql
from marketlake.sources import bars as src_bars
from marketlake.sources import quotes as src_quotes
from marketlake.sources import search as src_search

AS_OF = "2024-02-01"

# --- windows ----------------------------------------------------------------------------------

# Decimals compared. Two engines differ in the last bits of a double, so a value is compared on the grid
# it lies on (means of 20 or 50 cents amounts), or on one so coarse that the last bits cannot matter.
# No value here can lie exactly between two steps of its grid.
DIFF, MEAN, MEAN_14, EMA, BAND = 4, 4, 3, 4, 4

DAY = "strftime(date, '%Y-%m-%d') AS date"
W = "PARTITION BY symbol ORDER BY date"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolled(fn: str, n: int, col: str = "close") -> str:
    return f"CASE WHEN count({col}) OVER {frame(n)} = {n} THEN {fn}({col}) OVER {frame(n)} END"


def chained(bars: str) -> str:
    """Row-by-row recursion for the exponential means, the definition itself."""
    fast, slow = "e.f + 2.0 / 13 * (r.close - e.f)", "e.s + 2.0 / 27 * (r.close - e.s)"
    return f"""+ r AS (SELECT symbol, date, close, row_number() OVER ({W}) AS n FROM {bars}),
    e AS (SELECT symbol, date, close, n, close AS f, close AS s, CAST(0 AS DOUBLE) AS g FROM r WHERE n = 1
      UNION ALL
      SELECT r.symbol, r.date, r.close, r.n, {fast}, {slow}, e.g + 0.2 * (({fast}) - ({slow}) - e.g)
      FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1)"""


def moves(bars: str) -> str:
    return f"""+ d AS (SELECT symbol, date, close, close - lag(close) OVER ({W}) AS diff FROM {bars}),
    g AS (SELECT *, CASE WHEN diff > 0 THEN diff ELSE 0.0 END AS gain,
                 CASE WHEN diff < 0 THEN -diff ELSE 0.0 END AS loss FROM d),
    m AS (SELECT *, {rolled("avg", 14, "gain")} AS gain_mean, {rolled("avg", 14, "loss")} AS loss_mean FROM g)"""


RSI = """CASE WHEN loss_mean > 0 THEN 100 - 100 / (1 + gain_mean / loss_mean)
    WHEN loss_mean = 0 AND gain_mean > 0 THEN 100.0 END"""


@query("sma_20", sql(f"SELECT symbol, {DAY}, floor(({rolled('avg', 20)}) * 1e{MEAN} + 0.5) / 1e{MEAN} AS sma_20 FROM bars", "bars"))
def _(spark, sf):
    return shown(ind.sma(fx.bars_lineitem(spark, sf), 20), "symbol", "date", r=f"sma_20:{MEAN}")


@query("sma_50", sql(f"SELECT symbol, {DAY}, floor(({rolled('avg', 50)}) * 1e{MEAN} + 0.5) / 1e{MEAN} AS sma_50 FROM bars", "bars"))
def _(spark, sf):
    return shown(ind.sma(fx.bars_lineitem(spark, sf), 50), "symbol", "date", r=f"sma_50:{MEAN}")


@query("price_diff", sql(moves("bars") + f" SELECT symbol, {DAY}, {six(f'diff:{DIFF}')} FROM g", "bars"))
def _(spark, sf):
    return shown(ind.price_diff(fx.bars_lineitem(spark, sf)), "symbol", "date", r=f"diff:{DIFF}")


@query("gain_loss", sql(moves("bars") + f" SELECT symbol, {DAY}, {six(f'gain:{DIFF} loss:{DIFF}')} FROM g", "bars"))
def _(spark, sf):
    return shown(ind.gain_loss(fx.bars_lineitem(spark, sf)), "symbol", "date", r=f"gain:{DIFF} loss:{DIFF}")


@query("gain_loss_mean_14", sql(moves("bars") + f" SELECT symbol, {DAY}, {six(f'gain_mean:{MEAN_14} loss_mean:{MEAN_14}')} FROM m", "bars"))
def _(spark, sf):
    return shown(ind.gain_loss_mean(fx.bars_lineitem(spark, sf)), "symbol", "date", r=f"gain_mean:{MEAN_14} loss_mean:{MEAN_14}")


@query("rsi_14", sql(moves("bars") + f" SELECT symbol, {DAY}, floor(({RSI}) * 1e6 + 0.5) / 1e6 AS rsi_14 FROM m", "bars"))
def _(spark, sf):
    return shown(ind.rsi(fx.bars_lineitem(spark, sf)), "symbol", "date", r="rsi_14")


@query("ema", sql(
    chained("bars") + f" SELECT symbol, {DAY}, floor((f) * 1e{EMA} + 0.5) / 1e{EMA} AS ema_12, floor((s) * 1e{EMA} + 0.5) / 1e{EMA} AS ema_26 FROM e",
    "bars", recursive=True))
def _(spark, sf):
    return shown(ind.ema(fx.bars_lineitem(spark, sf)), "symbol", "date", r=f"ema_12:{EMA} ema_26:{EMA}")


@query("macd", sql(
    chained("bars") + f" SELECT symbol, {DAY}, floor((f - s) * 1e{EMA} + 0.5) / 1e{EMA} AS macd FROM e", "bars", recursive=True))
def _(spark, sf):
    return shown(ind.macd(fx.bars_lineitem(spark, sf)), "symbol", "date", r=f"macd:{EMA}")


@query("macd_signal", sql(
    chained("bars") + f" SELECT symbol, {DAY}, floor((g) * 1e{EMA} + 0.5) / 1e{EMA} AS signal_line FROM e", "bars", recursive=True))
def _(spark, sf):
    return shown(ind.macd_signal(fx.bars_lineitem(spark, sf)), "symbol", "date", r=f"signal_line:{EMA}")


@query("bollinger", sql(
    f"""+ b AS (SELECT symbol, date, {rolled('avg', 20)} AS bb_middle, {rolled('stddev_samp', 20)} AS dev FROM bars)
    SELECT symbol, {DAY}, floor((bb_middle) * 1e{MEAN} + 0.5) / 1e{MEAN} AS bb_middle,
           floor((bb_middle + 2 * dev) * 1e{BAND} + 0.5) / 1e{BAND} AS bb_upper, floor((bb_middle - 2 * dev) * 1e{BAND} + 0.5) / 1e{BAND} AS bb_lower FROM b""", "bars"))
def _(spark, sf):
    return shown(ind.bollinger(fx.bars_lineitem(spark, sf)), "symbol", "date", r=f"bb_middle:{MEAN} bb_upper:{BAND} bb_lower:{BAND}")


INDICATORS = (
    f"close:4 macd:{EMA} signal_line:{EMA} sma_20:{MEAN} sma_50:{MEAN} rsi:6 "
    f"bb_middle:{MEAN} bb_upper:{BAND} bb_lower:{BAND}"
)


def indicators_sql(bars: str, *views: str, date: str = DAY) -> str:
    return sql(
        chained(bars) + moves(bars).replace("+", ",", 1) + f""",
        b AS (SELECT symbol, date, close, {rolled('avg', 20)} AS sma_20, {rolled('avg', 50)} AS sma_50,
                     {rolled('stddev_samp', 20)} AS dev FROM {bars}),
        a AS (SELECT symbol, date, b.close, f - s AS macd, g AS signal_line, sma_20, sma_50, {RSI} AS rsi,
                     sma_20 AS bb_middle, sma_20 + 2 * dev AS bb_upper, sma_20 - 2 * dev AS bb_lower
              FROM b JOIN e USING (symbol, date) JOIN m USING (symbol, date))
        SELECT symbol, {date}, {six(INDICATORS)} FROM a""", *views, recursive=True)


@query("technical_indicators", indicators_sql("bars", "bars"))
def technical_indicators(spark, sf):
    return shown(ind.technical_indicators(fx.bars_lineitem(spark, sf)), "symbol", "date", r=INDICATORS)


@query("technical_indicators_hot_symbol", indicators_sql("hot_bars", "hot_bars", date="epoch_us(date) AS date"))
def _(spark, sf):
    bars = fx.hot_bars(spark, sf).select("symbol", "date", "close")
    done = ind.technical_indicators(bars, hot_rows=1_000, block_rows=1_000)
    return shown(done.withColumn("date", F.unix_micros("date")), "symbol", "date", r=INDICATORS)


# --- history and series -----------------------------------------------------------------------

@query("history_first_30", sql(f"""SELECT symbol, {DAY}, floor((close) * 1e6 + 0.5) / 1e6 AS close, rank FROM
    (SELECT *, row_number() OVER ({W}) AS rank FROM bars) WHERE rank <= 30""", "bars"))
def _(spark, sf):
    return shown(rel.history(fx.bars_lineitem(spark, sf)), "symbol", "date", "rank", r="close")


@query("series_arrays", sql(f"""SELECT symbol, rank - 1 AS pos, {DAY}, floor((close) * 1e6 + 0.5) / 1e6 AS price FROM
    (SELECT *, row_number() OVER ({W}) AS rank FROM bars) WHERE rank <= 30""", "bars"))
def _(spark, sf):
    series = rel.chart_series(fx.bars_lineitem(spark, sf))
    points = series.select("symbol", F.posexplode(F.arrays_zip("dates", "prices")).alias("pos", "p"))
    return shown(points.select("symbol", "pos", F.col("p.dates").alias("date"), F.col("p.prices").alias("price")),
                 "symbol", "pos", "date", r="price")


@query("bars_from_json", sql(f"""SELECT 'bar' AS kind, symbol, {DAY}, close, volume FROM bars WHERE symbol NOT LIKE '%7'
    UNION ALL SELECT 'reject', symbol, NULL, NULL, NULL
    FROM (SELECT DISTINCT symbol, year(date) FROM bars WHERE symbol LIKE '%7')""", "bars"))
def _(spark, sf):
    landed = src_bars.bars_from_json(fx.series_json(spark, sf))
    good = landed.good.select(
        F.lit("bar").alias("kind"), "symbol", F.col("date").cast("string").alias("date"), "close", "volume")
    bad = landed.rejects.select(F.lit("reject").alias("kind"), "symbol", "date")
    return good.unionByName(bad, allowMissingColumns=True)


@query("trailing_days", """SELECT event_id, user_id, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-16'""")
def _(spark, sf):
    events = fx.table(spark, sf, "events")
    return rel.trailing_days(events, "ts", "2024-01-15", 7).select("event_id", "user_id", "value")


# --- quotes -----------------------------------------------------------------------------------

A, B = f"'{lookups.SOURCE_A}'", f"'{lookups.SOURCE_B}'"


@query("quotes_vendor_a", sql(f"SELECT *, {A} AS source FROM quotes_a", "quotes_a"))
def _(spark, sf):
    return src_quotes.quotes_vendor_a(fx.quotes_a_raw(spark, sf), AS_OF)


@query("quotes_vendor_b", sql(f"SELECT *, {B} AS source FROM quotes_b", "quotes_b"))
def _(spark, sf):
    return src_quotes.quotes_vendor_b(fx.quotes_b_raw(spark, sf))


FALLBACK = f"""+ asked AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol FROM part
      UNION ALL SELECT * FROM (VALUES ('AAPL'), ('TSLA'), ('ZZZZ'))),
    fixed AS (SELECT * FROM (VALUES ('AAPL', 175.64, 2.32, 78523641), ('TSLA', 193.57, -2.31, 57234891))
              AS f(symbol, price, change, volume))
    SELECT symbol, floor((coalesce(a.price, b.price, f.price)) * 1e6 + 0.5) / 1e6 AS price,
      floor((coalesce(a.change, b.change, f.change)) * 1e6 + 0.5) / 1e6 AS change,
      coalesce(a.volume, b.volume, f.volume, -1) AS volume,
      CASE WHEN a.symbol IS NOT NULL THEN {A} WHEN b.symbol IS NOT NULL THEN {B}
           WHEN f.symbol IS NOT NULL THEN 'static' ELSE 'none' END AS source
    FROM asked LEFT JOIN quotes_a a USING (symbol) LEFT JOIN quotes_b b USING (symbol) LEFT JOIN fixed f USING (symbol)"""


@query("quote_fallback", sql(FALLBACK, "quotes_a", "quotes_b"))
def _(spark, sf):
    symbols = fx.quotes(spark, sf).select("symbol").unionByName(
        spark.createDataFrame([("AAPL",), ("TSLA",), ("ZZZZ",)], "symbol string"))
    best = src_quotes.quote_fallback(
        symbols, src_quotes.quotes_vendor_a(fx.quotes_a_raw(spark, sf), AS_OF),
        src_quotes.quotes_vendor_b(fx.quotes_b_raw(spark, sf)), src_quotes.static_quotes(spark, AS_OF))
    return shown(best.fillna(-1, ["volume"]), "symbol", "volume", "source", r="price change")


@query("provider_union", sql(f"""SELECT symbol, price, volume, NULL AS high, {A} AS source FROM quotes_a
    UNION ALL SELECT symbol, price, volume, high, {B} FROM quotes_b""", "quotes_a", "quotes_b"))
def _(spark, sf):
    both = rel.provider_union(
        src_quotes.quotes_vendor_a(fx.quotes_a_raw(spark, sf), AS_OF),
        src_quotes.quotes_vendor_b(fx.quotes_b_raw(spark, sf)))
    return both.select("symbol", "price", "volume", "high", "source")


TIE = "abs({x} - floor({x}) - 0.5) < 1e-6"


@query("quote_metrics", sql(f"""+ q AS (SELECT symbol, price, change / price * 100 AS pct, price + abs(change) * 1.1 AS high,
    price - abs(change) * 0.9 AS low, price * volume AS market_cap FROM quotes)
    SELECT symbol, {six('high low market_cap')}, CASE WHEN {TIE.format(x='pct * 100')} THEN -1 ELSE round(pct, 2) END AS change_percent
    FROM q""", "quotes"))
def _(spark, sf):
    done = rel.quote_metrics(fx.quotes(spark, sf))
    tie = F.expr(TIE.format(x="change / price * 10000"))  # which way a tie goes is not compared
    return shown(done.withColumn("change_percent", F.when(tie, -1).otherwise(F.col("change_percent"))),
                 "symbol", "change_percent", r="high low market_cap")


# --- search and snapshots ---------------------------------------------------------------------

SEARCH = """+ m AS (SELECT p_brand || '/' || CAST(p_partkey // 500 AS VARCHAR) AS query,
      CAST(p_partkey AS VARCHAR) AS symbol, p_name AS company_name,
      row_number() OVER (PARTITION BY p_brand, p_partkey // 500 ORDER BY p_partkey) - 1 AS rank FROM part),
    q AS (SELECT * FROM quotes_a WHERE CAST(symbol AS BIGINT) % 7 <> 0)
    SELECT query, rank, symbol, company_name, 'USD' AS currency, coalesce(price, 0) AS price,
      coalesce(change, 0) AS change, coalesce(change_percent, 0) AS change_percent
    FROM m LEFT JOIN q USING (symbol)"""


@query("symbol_search", sql(SEARCH + " WHERE rank < 10", "quotes_a"))
def _(spark, sf):
    quotes = src_search.search_quotes(fx.quotes_a_raw(spark, sf))
    return src_search.symbol_search(fx.search_raw(spark, sf), quotes).drop("region")


@query("search_quote_enrich", sql(SEARCH, "quotes_a"))
def _(spark, sf):
    every = src_search.search_matches(fx.search_raw(spark, sf), k=None)
    return rel.enrich_quotes(every, src_search.search_quotes(fx.quotes_a_raw(spark, sf))).drop("region")


SNAPSHOT = """SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(p_retailprice AS DOUBLE) END AS price
    FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 10 <> 0 AND p_partkey % 3 <> 2"""


@query("company_snapshot", SNAPSHOT)
def _(spark, sf):
    both = src_search.company_snapshot(fx.overview_raw(spark, sf), fx.quotes_a_raw(spark, sf))
    return both.select(
        "symbol", F.try_element_at("overview", F.lit("Name")).alias("name"),
        F.try_element_at("quote", F.lit("05. price")).try_cast("double").alias("price"))


@query("overview_quote", sql("""SELECT symbol, s_name AS name, price FROM quotes
    JOIN supplier ON symbol = CAST(s_suppkey AS VARCHAR)""", "quotes"))
def _(spark, sf):
    companies = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"))
    return rel.overview_quote(companies, fx.quotes(spark, sf).select("symbol", "price"))


def _fact(at: int, other: str) -> str:
    known = " ".join(f"WHEN '{c[0]}' THEN '{c[at]}'" for c in lookups.COMPANIES if c[0] in ("AAPL", "NVDA"))
    return f"CASE symbol {known} ELSE {other} END"


@query("company_dim", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey,
      CASE l_suppkey % 4 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'NVDA' ELSE 'X' || CAST(l_suppkey AS VARCHAR) END AS symbol
      FROM lineitem)
    SELECT symbol, count(*) AS lines,
      CASE symbol WHEN 'AAPL' THEN 'Apple Inc.' WHEN 'NVDA' THEN 'NVIDIA Corporation' ELSE symbol || ' Inc.' END AS name,
      CASE WHEN symbol IN ('AAPL', 'NVDA') THEN 'Technology' END AS sector,
      {_fact(3, "NULL")} AS business, {_fact(4, "'" + lookups.UNKNOWN_PRODUCTS + "'")} AS products FROM s GROUP BY symbol""")
def _(spark, sf):
    supp = F.col("l_suppkey")
    symbol = F.when(supp % 4 == 0, "AAPL").when(supp % 4 == 1, "NVDA").otherwise(F.concat(F.lit("X"), supp.cast("string")))
    lines = fx.table(spark, sf, "lineitem").select(symbol.alias("symbol"))
    return rel.with_company(lines).groupBy("symbol", "name", "sector", "business", "products").agg(F.count("*").alias("lines"))
