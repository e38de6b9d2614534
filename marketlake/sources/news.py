"""News payloads of two providers and the company news rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake import lookups
from marketlake.functions.scalars import default_if_missing, iso_timestamp, lookup, nested_field
from marketlake.operators.relational import usable_news
from marketlake.schemas import ITEM_LIST_JSON, NEWS_A_JSON, NEWS_B_JSON


def news_vendor_a(raw: DataFrame, k: int | None = 10, payload: str = "payload") -> DataFrame:
    """The first ``k`` articles of every answer with status 'ok'."""
    read = raw.select("feed", F.from_json(payload, NEWS_A_JSON).alias("a")).filter(F.col("a.status") == "ok")
    return read.select("feed", F.posexplode(_first(F.col("a.articles"), k)).alias("pos", "i")).select(
        "feed", "pos", F.col("i.title").alias("title"), F.col("i.url").alias("url"),
        nested_field(F.col("i"), "source", "name").alias("source"),
        F.col("i.publishedAt").try_cast("timestamp").alias("published_at"),
        F.col("i.description").alias("content"))


def news_vendor_b(raw: DataFrame, k: int | None = 10, payload: str = "payload") -> DataFrame:
    """The first ``k`` articles of every answer that is a list; anything else is no news."""
    listed = raw.filter(F.ltrim(F.col(payload)).startswith("["))  # from_json would wrap a lone object
    read = listed.select("feed", F.from_json(payload, NEWS_B_JSON).alias("a"))
    return read.select("feed", F.posexplode(_first(F.col("a"), k)).alias("pos", "i")).select(
        "feed", "pos", F.col("i.headline").alias("title"), F.col("i.url").alias("url"),
        F.col("i.source").alias("source"), F.timestamp_seconds("i.datetime").alias("published_at"),
        F.col("i.summary").alias("content"))


def _first(items, k: int | None):
    return items if k is None else F.slice(items, 1, k)


def items_from_json(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Company news answers (symbol, payload) as (symbol, arrival, item) rows."""
    return raw.filter(F.ltrim(F.col(payload)).startswith("[")).select(
        "symbol", F.posexplode(F.from_json(payload, ITEM_LIST_JSON)).alias("arrival", "item"))


def company_news(items: DataFrame, as_of: str, days: int = 7, k: int = 20) -> DataFrame:
    """News of the last ``days`` days per upper-cased symbol: the first ``k``, and only then the usable ones.

    A default stands in for an absent key only. The cut to ``k`` happens per task before the shuffle.
    """
    day = F.lit(as_of).cast("date")
    at = F.timestamp_seconds(
        default_if_missing(F.col("item"), "datetime", F.unix_timestamp(day.cast("timestamp")).cast("string"))
        .try_cast("bigint"))
    recent = items.select(F.upper("symbol").alias("symbol"), "arrival", "item", at.alias("at")).filter(
        F.to_date("at").between(F.date_sub(day, days), day))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("arrival"))
    cut = recent.withColumn("rank", first).filter(F.col("rank") <= k)
    item = F.col("item")
    return usable_news(cut.select(
        "symbol", "rank", lookup(item, "headline").alias("headline"),
        default_if_missing(item, "summary", lookups.NO_SUMMARY).alias("summary"),
        lookup(item, "url").alias("url"),
        default_if_missing(item, "source", lookups.NO_SOURCE).alias("source"),
        iso_timestamp(F.col("at")).alias("datetime")))
