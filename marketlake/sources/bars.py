"""Daily-series payloads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.schemas import DAILY_SERIES_JSON

FIELDS = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"}


class Landed(NamedTuple):
    good: DataFrame
    rejects: DataFrame


def bars_from_json(raw: DataFrame, payload: str = "payload") -> Landed:
    """Typed bars from (symbol, payload). Payloads without a series, and days that do not parse, are rejects."""
    series = F.from_json(payload, DAILY_SERIES_JSON)["Time Series (Daily)"]
    read = raw.select("symbol", F.col(payload).alias("payload"), series.alias("days"))
    no_series = read.filter(F.col("days").isNull()).select(
        "symbol", F.lit(None).cast("string").alias("date"), F.lit("no series").alias("reason"))
    typed = read.select("symbol", F.explode("days").alias("day", "v")).select(
        "symbol", "day", F.col("day").try_cast("date").alias("date"),
        *[F.try_element_at("v", F.lit(key)).try_cast("double").alias(name) for name, key in FIELDS.items()])
    whole = F.col("date").isNotNull()
    for name in FIELDS:
        whole = whole & F.col(name).isNotNull()
    return Landed(
        typed.filter(whole).drop("day"),
        no_series.unionByName(typed.filter(~whole).select(
            "symbol", F.col("day").alias("date"), F.lit("bad value").alias("reason"))))
