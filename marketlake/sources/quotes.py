"""Quote payloads of two providers and the order in which they are believed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake import lookups
from marketlake.functions.scalars import day_string, default_if_missing, epoch_to_timestamp, pct_to_double
from marketlake.operators.relational import provider_union, quote_metrics
from marketlake.schemas import QUOTE_A_JSON, QUOTE_B_JSON

COLUMNS = ["symbol", "price", "change", "change_percent", "volume", "latest_trading_day", "source"]


def _whole(c: Column) -> Column:
    """Whole number, also from a number written with a fraction."""
    return F.coalesce(c.try_cast("bigint"), F.floor(c.try_cast("double")).try_cast("bigint"))


def _complete(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def quotes_vendor_a(raw: DataFrame, as_of: str, payload: str = "payload") -> DataFrame:
    """Quotes of provider A. An empty answer gives no row; a default stands in only for an absent key."""
    quote = F.from_json(payload, QUOTE_A_JSON)["Global Quote"]
    read = raw.select("symbol", quote.alias("q")).filter(F.size("q") > 0)
    q = F.col("q")
    typed = read.select(
        "symbol",
        default_if_missing(q, "05. price", "0").try_cast("double").alias("price"),
        default_if_missing(q, "09. change", "0").try_cast("double").alias("change"),
        pct_to_double(default_if_missing(q, "10. change percent", "0%")).alias("change_percent"),
        default_if_missing(q, "06. volume", "0").try_cast("bigint").alias("volume"),
        default_if_missing(q, "07. latest trading day", as_of).alias("latest_trading_day"),
        F.lit(lookups.SOURCE_A).alias("source"))
    return _complete(typed, "price", "change", "change_percent", "volume")


def quotes_vendor_b(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Quotes of provider B: valid iff the price key is there; an explicit null number spoils the row."""
    read = raw.select("symbol", F.from_json(payload, QUOTE_B_JSON).alias("q")).filter(
        F.map_contains_key("q", F.lit("c")))
    q = F.col("q")

    def number(key: str) -> Column:
        return default_if_missing(q, key, "0").try_cast("double")

    typed = read.select(
        "symbol", number("c").alias("price"), number("d").alias("change"), number("dp").alias("change_percent"),
        number("h").alias("high"), number("l").alias("low"),
        _whole(default_if_missing(q, "v", "0")).alias("volume"),
        day_string(epoch_to_timestamp(_whole(default_if_missing(q, "t", "0")))).alias("latest_trading_day"),
        F.lit(lookups.SOURCE_B).alias("source"))
    return _complete(typed, "price", "change", "change_percent", "high", "low", "volume", "latest_trading_day")


def static_quotes(spark, as_of: str) -> DataFrame:
    """The last-resort quotes with their derived figures."""
    rows = spark.createDataFrame(
        lookups.STATIC_QUOTES, "symbol string, price double, change double, name string, volume bigint")
    return quote_metrics(rows).withColumns({
        "latest_trading_day": F.lit(as_of), "source": F.lit(lookups.SOURCE_STATIC)})


def quote_fallback(symbols: DataFrame, *providers: DataFrame) -> DataFrame:
    """For every symbol the quote of the first provider that has one; a null row with source 'none' else.

    The choice is an aggregate on (provider rank), so each task sends at most one row per symbol.
    """
    ranked = [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(providers)]
    rows = provider_union(*ranked)
    value = [c for c in rows.columns if c not in ("symbol", "_rank")]
    # Of two quotes of one provider the later day, then the higher price, then the rest in the order of the columns.
    order = F.struct((-F.col("_rank")).alias("_r"), "latest_trading_day", "price", *[c for c in value if c not in ("latest_trading_day", "price")])
    best = rows.groupBy("symbol").agg(F.max_by(F.struct(*value), order).alias("q")).select("symbol", "q.*")
    return symbols.select("symbol").distinct().join(best, "symbol", "left").withColumn(
        "source", F.coalesce("source", F.lit(lookups.SOURCE_NONE)))
