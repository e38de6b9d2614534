"""Filters, joins, limits and unions over the tables.

Join sides are never forced to broadcast here: adaptive execution broadcasts a side by its measured
size and splits the skewed partitions of the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake import lookups
from marketlake.functions.scalars import template


class Parts(NamedTuple):
    good: DataFrame
    bad: DataFrame


def holdings_for(holdings: DataFrame, users: Sequence[int] | DataFrame) -> DataFrame:
    """Holdings of the given users: a pushed-down filter for a few ids, a semi join for a table of them."""
    out = ["user_id", "symbol", "quantity", "average_price", "last_updated"]
    if isinstance(users, DataFrame):
        return holdings.join(users.select("user_id"), "user_id", "left_semi").select(*out)
    return holdings.filter(F.col("user_id").isin(*users)).select(*out)


def split_required(raw: DataFrame, fields: Sequence[str], payload: str = "payload") -> Parts:
    """Records that have all the keys, and the others with a reason. Null and empty values pass."""
    read = raw.withColumn("fields", F.from_json(payload, "map<string, string>"))
    has = [F.map_contains_key("fields", F.lit(f)) for f in fields]
    complete = F.coalesce(reduce(lambda a, b: a & b, has), F.lit(False))
    return Parts(
        read.filter(complete), raw_reject(read.filter(~complete), payload, lookups.MISSING_FIELDS))


def raw_reject(df: DataFrame, payload: str, reason: str) -> DataFrame:
    return df.drop("fields").withColumn("reason", F.lit(reason))


def usable_news(news: DataFrame) -> DataFrame:
    """Rows with both a headline and a url."""
    return news.filter((F.coalesce("headline", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def quote_metrics(quotes: DataFrame) -> DataFrame:
    """Percentage, day range and market value derived from price, change and volume."""
    swing = F.abs("change")
    return quotes.withColumns({
        "change_percent": F.round(F.try_divide(F.col("change"), F.col("price")) * 100, 2),
        "high": F.col("price") + swing * 1.1,
        "low": F.col("price") - swing * 0.9,
        "market_cap": F.col("price") * F.col("volume"),
    })


def trailing_days(df: DataFrame, ts: str, as_of: str, n: int) -> DataFrame:
    """Rows of the days from ``as_of - n`` up to and with ``as_of``.

    The bounds are constants of the column's own type, so the column stays bare and the filter reaches
    the scan and prunes partitions.
    """
    day, kind = F.lit(as_of).cast("date"), df.schema[ts].dataType
    return df.filter((F.col(ts) >= F.date_sub(day, n).cast(kind)) & (F.col(ts) < F.date_add(day, 1).cast(kind)))


def enrich_quotes(matches: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each match with its quote; zeros where there is none."""
    known = quotes.select("symbol", "price", "change", "change_percent")
    return matches.join(known, "symbol", "left").withColumns({
        c: F.coalesce(c, F.lit(0.0)) for c in ("price", "change", "change_percent")})


def overview_quote(overview: DataFrame, quotes: DataFrame) -> DataFrame:
    return overview.join(quotes, "symbol", "inner")


def company_table(spark) -> DataFrame:
    return spark.createDataFrame(
        lookups.COMPANIES, "symbol string, name string, sector string, business string, products string")


def with_company(df: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Company facts by symbol; an unknown one is named after its symbol, and its sector and business are null."""
    dim = company_table(df.sparkSession) if companies is None else companies
    return df.join(dim, "symbol", "left").withColumns({
        "name": F.coalesce("name", F.concat("symbol", F.lit(" Inc."))),
        "business": F.coalesce("business", template(lookups.UNKNOWN_BUSINESS, F.col("sector"))),
        "products": F.coalesce("products", F.lit(lookups.UNKNOWN_PRODUCTS)),
    })


def user_holdings(users: DataFrame, holdings: DataFrame, how: str = "inner") -> DataFrame:
    return users.select(F.col("id").alias("user_id"), "username").join(
        holdings.select("user_id", "symbol", "quantity", "average_price"), "user_id", how)


def session_messages(sessions: DataFrame, msgs: DataFrame) -> DataFrame:
    return sessions.select("session_id", "user_id").join(msgs, "session_id")


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group. Spark cuts each task to ``k`` per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def recent_trades(trades: DataFrame, k: int = 20) -> DataFrame:
    """Newest ``k`` trades per user."""
    return first_per_group(trades, ["user_id"], [F.col("timestamp").desc(), F.col("id").desc()], k)


def history(bars: DataFrame, k: int = 30, end: str = "first") -> DataFrame:
    """The oldest ``k`` bars per symbol; ``end='last'`` gives the newest."""
    date = F.col("date") if end == "first" else F.col("date").desc()
    return first_per_group(bars, ["symbol"], [date], k)


def chart_series(bars: DataFrame, n: int = 30, end: str = "first") -> DataFrame:
    """Per symbol two parallel arrays of ``n`` dates and closes, ascending. Cut to ``n`` rows first."""
    points = F.array_sort(F.collect_list(F.struct("date", "close")))
    return history(bars, n, end).groupBy("symbol").agg(points.alias("p")).select(
        "symbol",
        F.transform("p", lambda x: x["date"]).alias("dates"),
        F.transform("p", lambda x: x["close"]).alias("prices"))


def news_top(news: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` articles by arrival, of all or of each group."""
    if not by:
        return news.orderBy("arrival").limit(k)
    return first_per_group(news, by, [F.col("arrival")], k)


def limit_then_filter(df: DataFrame, k: int, order: Sequence[Column], pred: Column,
                      by: Sequence[str] = ()) -> DataFrame:
    """Cut to ``k`` rows, then filter: the result may hold fewer than ``k``."""
    if not by:
        return df.orderBy(*order).limit(k).filter(pred)
    return first_per_group(df, by, order, k).filter(pred)


def provider_union(*frames: DataFrame) -> DataFrame:
    """Rows of differently shaped providers in one schema, nulls where a provider has no such column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
