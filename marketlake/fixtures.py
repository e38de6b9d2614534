"""The driver's tables seen as the tables this package works on (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUY_EVENTS = ("purchase", "view", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per event; the user stands for the symbol and the event time for the date."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("date"),
        F.col("event_id").alias("id"),
        F.col("value").alias("close"),
    )


def bars_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: the supplier stands for the symbol and the ship date for the date."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(
        F.max("l_extendedprice").alias("open"),
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def trades_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.concat(F.lit("S"), (k % 5).cast("string")).alias("symbol"),
        F.when(F.col("event_type").isin(*BUY_EVENTS), "BUY").otherwise("SELL").alias("transaction_type"),
        (k % 10 + 1).alias("quantity"),
        F.col("value").alias("price"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from_events(table(spark, sf_dir, "events"))


def hot_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with a third of all rows on one account and symbol."""
    hot = F.col("id") % 3 == 0
    return trades(spark, sf_dir).withColumns({
        "user_id": F.when(hot, F.lit(-1).cast("bigint")).otherwise(F.col("user_id")),
        "symbol": F.when(hot, "HOT").otherwise(F.col("symbol")),
    })


def hot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event bars with a third of all rows on one symbol."""
    return bars_events(spark, sf_dir).withColumn(
        "symbol", F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("symbol")))


def messages_from_conversations(rows: DataFrame) -> DataFrame:
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("text").alias("message"),
        (F.col("role") == "user").alias("is_user"),
        F.timestamp_seconds(F.col("turn")).alias("timestamp"),
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_conversations(table(spark, sf_dir, "conversations"))


def hot_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a third of the sessions run together into one; the id gives the order."""
    hot = F.floor(F.col("id") / 1000) % 3 == 0
    return chat_messages(spark, sf_dir).withColumns({
        "session_id": F.when(hot, "HOT").otherwise(F.col("session_id")),
        "timestamp": F.timestamp_seconds(F.col("id")),
    })


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.max("turn").alias("last")).select(
        F.col("conv_id").alias("id"),
        (F.col("conv_id") % 50).alias("user_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.timestamp_seconds(F.lit(0)).alias("created_at"),
        F.timestamp_seconds(F.col("last")).alias("last_interaction"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("email"),
        F.timestamp_seconds(F.col("c_custkey") * 3600).alias("created_at"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up requests with many clashes on both names and addresses."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("arrival"),
        F.concat(F.lit("u"), (k * k % 397).cast("string")).alias("username"),
        F.concat(F.lit("e"), ((k * k * k + 11 * k) % 491).cast("string")).alias("email"),
    )


def family_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up requests that clash within families of sixty."""
    k = F.col("c_custkey")
    family = F.floor(k / 60).cast("string")
    return table(spark, sf_dir, "customer").select(
        k.alias("arrival"),
        F.concat(F.lit("u"), family, F.lit("-"), (k * k % 17).cast("string")).alias("username"),
        F.concat(F.lit("e"), family, F.lit("-"), ((k * k * k + 11 * k) % 23).cast("string")).alias("email"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening positions: one per customer and nation."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_custkey") % 150).alias("user_id"),
        F.concat(F.lit("S"), F.floor(F.col("c_custkey") / 150).cast("string")).alias("symbol"),
        (F.col("c_custkey") % 40 + 1).alias("quantity"),
        F.abs("c_acctbal").alias("average_price"),
        F.timestamp_seconds(F.col("c_custkey")).alias("last_updated"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("arrival"),
        F.substring("text", 1, 80).alias("headline"),
        F.col("text").alias("summary"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source"),
        F.col("lang"),
        F.timestamp_seconds(F.col("doc_id") * 3600).alias("published_at"),
    )


def day_stamp(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def series_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily-series payload per symbol and year; symbols that end in 7 get payloads without a series."""
    day = F.struct(
        F.col("open").cast("string").alias("1. open"),
        F.col("high").cast("string").alias("2. high"),
        F.col("low").cast("string").alias("3. low"),
        F.col("close").cast("string").alias("4. close"),
        F.col("volume").cast("string").alias("5. volume"),
    )
    per_year = bars_lineitem(spark, sf_dir).groupBy("symbol", F.year("date").alias("year")).agg(
        F.map_from_entries(F.collect_list(F.struct(day_stamp(F.col("date")), day))).alias("days"))
    payload = F.when(F.col("symbol").endswith("7"), '{"Note": "call limit"}').otherwise(
        F.to_json(F.struct(F.col("days").alias("Time Series (Daily)"))))
    return per_year.select("symbol", payload.alias("payload"))


def quotes_a_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider A's answer for every part: a quote, an empty quote or no quote at all."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    quote = F.when(key % 7 == 0, F.create_map(  # no percentage, volume or day
        F.lit("05. price"), F.col("p_retailprice").cast("string"),
        F.lit("09. change"), F.lit("-0.5"),
    )).otherwise(F.create_map(
        F.lit("05. price"), F.col("p_retailprice").cast("string"),
        F.lit("06. volume"), (key * 10).cast("string"),
        F.lit("07. latest trading day"), F.lit("2024-01-05"),
        F.lit("09. change"), (F.col("p_size") - 25).cast("string"),
        F.lit("10. change percent"), F.concat((F.col("p_size") - 25).cast("string"), F.lit(".25%")),
    ))
    return part.select(
        key.cast("string").alias("symbol"),
        F.when(key % 3 == 0, F.to_json(F.struct(quote.alias("Global Quote"))))
        .when(key % 3 == 1, '{"Global Quote": {}}').otherwise('{"Note": "call limit"}').alias("payload"),
    )


def quotes_b_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider B's answer for every part; many are errors, some hold a null or lack fields."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    price = F.col("p_retailprice").cast("string")
    full = F.concat(
        F.lit('{"c": '), price, F.lit(', "d": 1.5, "dp": 0.25, "h": '), price, F.lit(', "l": '), price,
        F.lit(', "v": '), key.cast("string"), F.lit(', "t": '), (key * 86400).cast("string"), F.lit("}"))
    payload = (
        F.when(key % 3 != 1, "{}")
        .when(key % 5 == 0, F.concat(F.lit('{"c": '), price, F.lit("}")))
        .when(key % 11 == 0, F.concat(F.lit('{"c": '), price, F.lit(', "d": null}')))
        .when(key % 13 == 0, F.lit('{"error": "no access"}'))
        .otherwise(full)
    )
    return part.select(key.cast("string").alias("symbol"), payload.alias("payload"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain quotes, one per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("symbol"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_size") - 25).cast("double").alias("change"),
        (F.col("p_partkey") * 10).alias("volume"),
    )


def search_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search answer per brand and range of 500 part keys, listing the parts by key."""
    match = F.struct(
        F.col("p_partkey").cast("string").alias("1. symbol"), F.col("p_name").alias("2. name"),
        F.lit("United States").alias("4. region"), F.lit("USD").alias("8. currency"))
    return table(spark, sf_dir, "part").groupBy(
        F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 500).cast("string")).alias("query")).agg(
        F.to_json(F.struct(F.transform(
            F.array_sort(F.collect_list(F.struct("p_partkey", match.alias("m")))), lambda x: x["m"]
        ).alias("bestMatches"))).alias("payload"))


def news_feed(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """Documents as provider payloads: one payload per (lang, source, block of 25 ids)."""
    rows = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "lang", "source", F.floor(F.col("doc_id") / 25).cast("string")).alias("feed"),
        "doc_id", F.substring("text", 1, 80).alias("head"), "text", "source")
    url = F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))
    if shape == "a":
        item = F.struct(
            F.col("head").alias("title"), url.alias("url"),
            F.struct(F.col("source").alias("name")).alias("source"),
            F.date_format(F.timestamp_seconds(F.col("doc_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
            F.col("text").alias("description"))
    else:
        item = F.struct(
            F.col("head").alias("headline"), url.alias("url"), F.col("source").alias("source"),
            (F.col("doc_id") * 3600).alias("datetime"), F.col("text").alias("summary"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("i")))), lambda x: x["i"])
    feeds = rows.groupBy("feed").agg(F.min("doc_id").alias("first"), items.alias("items"))
    if shape == "a":
        good = F.to_json(F.struct(F.lit("ok").alias("status"), F.col("items").alias("articles")))
        bad = F.to_json(F.struct(F.lit("error").alias("status"), F.col("items").alias("articles")))
    else:
        good = F.to_json(F.col("items"))
        bad = F.to_json(F.element_at("items", 1))
    return feeds.select("feed", F.when(F.col("first") % 4 == 3, bad).otherwise(good).alias("payload"))


def company_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items per company (the document's source); some lack a headline, a summary or a source."""
    doc = F.col("doc_id")
    base = F.create_map(
        F.lit("headline"), F.when(doc % 6 == 0, "").otherwise(F.substring("text", 1, 80)),
        F.lit("url"), F.concat(F.lit("https://example.org/"), doc.cast("string")),
        F.lit("datetime"), (F.lit(1704067200) + doc * 600).cast("string"))
    summary = F.create_map(F.lit("summary"), F.when(doc % 5 != 0, F.col("text")))
    source = F.create_map(F.lit("source"), F.col("lang"))
    none = F.create_map().cast("map<string,string>")
    item = F.map_concat(
        base, F.when(doc % 4 == 0, none).otherwise(summary), F.when(doc % 3 == 0, none).otherwise(source))
    return table(spark, sf_dir, "documents").select(
        F.lower("source").alias("symbol"), doc.alias("arrival"), item.alias("item"))


def overview_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company overview for every part; some answers are a message or empty."""
    key = F.col("p_partkey")
    good = F.to_json(F.struct(
        key.cast("string").alias("Symbol"), F.col("p_name").alias("Name"), F.col("p_type").alias("Industry")))
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("symbol"),
        F.when(key % 2 == 1, "{}").when(key % 10 == 0, '{"Information": "none"}').otherwise(good).alias("payload"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into pages at line ends; every ninth has another file type."""
    doc = F.col("doc_id")
    suffix = F.when(doc % 9 == 0, ".PDF").otherwise(".pdf")
    return table(spark, sf_dir, "documents").select(
        doc, F.concat(F.lit("file"), doc.cast("string"), suffix).alias("filename"),
        F.posexplode(F.split("text", "\n")).alias("page_no", "text"))

