import json

from pyspark.sql import functions as F

from marketlake import fixtures as fx
from marketlake.operators import relational as rel
from marketlake.schemas import TABLES
from marketlake.sinks import to_api_json
from marketlake.sources import bars, documents, news, quotes, search, tables


def raw(spark, rows, key="symbol"):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in rows], f"{key} string, payload string")


def test_bars_and_rejects(spark):
    day = {"1. open": "1", "2. high": "2", "3. low": "0.5", "4. close": "1.5", "5. volume": "10"}
    landed = bars.bars_from_json(raw(spark, [
        ("A", {"Time Series (Daily)": {"2024-01-02": day, "2024-01-03": {**day, "4. close": "n/a"}, "soon": day}}),
        ("B", {"Note": "limit"}), ("C", {}), ("D", "not json"),
        ("E", {"Time Series (Daily)": {"2024-01-02": {k: v for k, v in day.items() if k != "4. close"}}})]))
    assert [(r.symbol, str(r.date), r.close) for r in landed.good.collect()] == [("A", "2024-01-02", 1.5)]
    assert sorted((r.symbol, r.reason) for r in landed.rejects.collect()) == [
        ("A", "bad value"), ("A", "bad value"), ("B", "no series"), ("C", "no series"), ("D", "no series"), ("E", "bad value")]


def test_round_trip_of_bars(spark, sf):
    landed = bars.bars_from_json(fx.series_json(spark, sf))
    want = fx.bars_lineitem(spark, sf).filter(~F.col("symbol").endswith("7"))
    cols = ["symbol", "date", "open", "high", "low", "close", "volume"]
    assert landed.good.select(cols).exceptAll(want.select(cols)).isEmpty()
    assert landed.good.count() == want.count()


def test_vendor_a_edges(spark):
    full = {"05. price": "10.5", "06. volume": "7", "07. latest trading day": "2024-01-05", "09. change": "-1", "10. change percent": "-1.25%"}
    got = {r.symbol: r for r in quotes.quotes_vendor_a(raw(spark, [
        ("full", {"Global Quote": full}), ("bare", {"Global Quote": {"05. price": "3"}}),
        ("empty", {"Global Quote": {}}), ("none", {}), ("null", {"Global Quote": {"05. price": None}}),
        ("text", {"Global Quote": {"05. price": "dear"}}), ("frac", {"Global Quote": {**full, "06. volume": "1.5"}}),
        ("pct", {"Global Quote": {**full, "10. change percent": ""}})]), "2024-02-01").collect()}
    assert set(got) == {"full", "bare"}
    assert (got["full"].price, got["full"].change_percent, got["full"].volume) == (10.5, -1.25, 7)
    assert (got["bare"].change, got["bare"].volume, got["bare"].latest_trading_day) == (0.0, 0, "2024-02-01")


def test_vendor_b_edges(spark):
    full = {"c": 5.25, "d": 1, "dp": 2.5, "h": 6, "l": 4, "v": 12, "t": 86400}
    got = {r.symbol: r for r in quotes.quotes_vendor_b(raw(spark, [
        ("full", full), ("bare", {"c": 1}), ("null", {**full, "d": None}), ("nullc", {"c": None}), ("none", {}),
        ("err", {"error": "x"})])).collect()}
    assert set(got) == {"full", "bare"}
    assert (got["full"].price, got["full"].volume, got["full"].latest_trading_day) == (5.25, 12, "1970-01-02")
    assert (got["bare"].high, got["bare"].latest_trading_day) == (0.0, "1970-01-01")


def test_fallback_order_and_static_figures(spark):
    a = quotes.quotes_vendor_a(raw(spark, [("AAPL", {"Global Quote": {"05. price": "1"}})]), "2024-02-01")
    b = quotes.quotes_vendor_b(raw(spark, [("AAPL", {"c": 2}), ("MSFT", {"c": 3})]))
    symbols = spark.createDataFrame([("AAPL",), ("MSFT",), ("META",), ("QQQ",)], "symbol string")
    got = {r.symbol: r for r in quotes.quote_fallback(symbols, a, b, quotes.static_quotes(spark, "2024-02-01")).collect()}
    assert [(got[s].price, got[s].source) for s in ("AAPL", "MSFT", "META", "QQQ")] == [
        (1.0, "Alpha Vantage"), (3.0, "Finnhub"), (458.32, "static"), (None, "none")]
    assert got["META"].change_percent == 1.18
    assert abs(got["META"].high - (458.32 + 5.43 * 1.1)) < 1e-9


def test_news_payload_shapes(spark):
    art = {"title": "t", "url": "u", "source": {"name": "n"}, "publishedAt": "2024-01-02T03:04:05Z", "description": "d"}
    got = news.news_vendor_a(raw(spark, [
        ("ok", {"status": "ok", "articles": [art] * 12}), ("bad", {"status": "error", "articles": [art]}),
        ("none", {"status": "ok", "articles": []}), ("part", {"status": "ok", "articles": [{"title": "x"}]})], "feed")).collect()
    assert sorted((r.feed, r.pos) for r in got) == [("ok", i) for i in range(10)] + [("part", 0)]
    part = next(r for r in got if r.feed == "part")
    assert part.source is None and part.published_at is None
    item = {"headline": "h", "url": "u", "source": "s", "datetime": 60, "summary": "m"}
    got = news.news_vendor_b(raw(spark, [("list", [item] * 11), ("object", item), ("empty", [])], "feed")).collect()
    assert sorted((r.feed, r.pos) for r in got) == [("list", i) for i in range(10)]


def test_company_news_cuts_before_it_drops(spark):
    items = [{"headline": "" if i % 2 else "h", "url": "u", "datetime": 1704067200 + i} for i in range(30)]
    rows = news.items_from_json(raw(spark, [("abc", items)]))
    got = news.company_news(rows, "2024-01-03").collect()
    assert len(got) == 10 and {r.symbol for r in got} == {"ABC"}
    assert {(r.summary, r.source) for r in got} == {("No summary available", "Financial News")}
    assert news.company_news(rows, "2024-01-09", days=7).count() == 0
    assert news.company_news(rows, "2024-01-09", days=30).count() == 10


def test_explicit_null_summary_stays(spark):
    rows = news.items_from_json(raw(spark, [("A", [{"headline": "h", "url": "u", "summary": None, "datetime": 1704067200}])]))
    assert news.company_news(rows, "2024-01-02").first().summary is None


def test_documents_keep_page_order_and_suffix_case(spark):
    rows = [(1, "a.pdf", p, f"p{p}") for p in (10, 2, 1, 0, 2000)] + [(2, "b.PDF", 0, "x"), (3, "c.pdf", 0, "")]
    pages = spark.createDataFrame(rows, "doc_id long, filename string, page_no int, text string")
    got = {r.doc_id: r.text for r in documents.documents_from_pages(pages).collect()}
    assert got == {1: "p0\np1\np2\np10\np2000\n", 3: "\n"}


def test_search_keeps_vendor_rank(spark):
    match = lambda i: {"1. symbol": f"S{i}", "2. name": "n", "4. region": "r", "8. currency": "USD"}
    answers = raw(spark, [("q", {"bestMatches": [match(i) for i in range(12, 0, -1)]}), ("e", {})], "query")
    prices = search.search_quotes(raw(spark, [("S12", {"Global Quote": {"05. price": "2", "09. change": "1", "10. change percent": "5%"}})]))
    got = search.symbol_search(answers, prices).orderBy("rank").collect()
    assert [r.symbol for r in got] == [f"S{i}" for i in range(12, 2, -1)]
    assert (got[0].price, got[1].price) == (2.0, 0.0)


def test_required_keys_not_values(spark):
    rows = raw(spark, [("1", {"a": None, "b": ""}), ("2", {"a": 1}), ("3", "oops"), ("4", "")])
    parts = rel.split_required(rows, ["a", "b"])
    assert [r.symbol for r in parts.good.collect()] == ["1"]
    assert {(r.symbol, r.reason) for r in parts.bad.collect()} == {(s, "Missing required fields") for s in "234"}


def test_limit_before_filter(spark):
    rows = spark.range(100).withColumn("even", F.col("id") % 2 == 0)
    assert rel.limit_then_filter(rows, 20, [F.col("id")], F.col("even")).count() == 10


def test_tables_round_trip(spark, sf, tmp_path):
    tables.write_table(fx.trades(spark, sf), "trades", str(tmp_path / "t"))
    back = tables.read_table(spark, "trades", str(tmp_path / "t"))
    assert back.schema == TABLES["trades"] and back.count() == fx.trades(spark, sf).count()


def test_json_rows(spark):
    rows = spark.sql("SELECT 1 AS id, timestamp'2024-01-02 03:04:05' AS ts, CAST(NULL AS STRING) AS n")
    assert to_api_json(rows).first().value == '{"id":1,"ts":"2024-01-02T03:04:05","n":null}'


def test_series_first_and_last(spark, sf):
    data = fx.bars_lineitem(spark, sf)
    first, last = rel.chart_series(data, 30).first(), rel.chart_series(data, 30, "last")
    assert first.dates == sorted(first.dates) and len(first.dates) == len(first.prices) == 30
    tail = last.filter(F.col("symbol") == first.symbol).first()
    assert tail.dates == sorted(tail.dates) and tail.dates[0] > first.dates[0]


def test_company_facts_and_overview(spark):
    from marketlake.functions.text import company_overview

    rows = spark.createDataFrame([("AAPL",), ("ZZ",)], "symbol string")
    got = {r.symbol: r for r in company_overview(rel.with_company(rows)).collect()}
    assert got["AAPL"].overview.startswith("# Apple Inc. (AAPL) Analysis\n\nApple Inc. operates in the Technology sector")
    assert (got["ZZ"].name, got["ZZ"].sector, got["ZZ"].overview) == ("ZZ Inc.", None, None)
    assert got["ZZ"].products == "Various products and services in their industry"


def test_prompts(spark):
    from marketlake.functions.text import analysis_prompt

    rows = spark.sql("SELECT 'A' AS symbol, named_struct('x', 1) AS d UNION ALL SELECT 'B', NULL")
    a, b = [r.p for r in rows.select("symbol", analysis_prompt(F.col("symbol"), F.col("d"), "Study %s. ", "Be brief.").alias("p")).orderBy("symbol").collect()]
    assert 'Here is the available data for A: {"x":1}\n\n' in a and "available data" not in b
