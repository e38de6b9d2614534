"""Declared schemas of the five tables and of the vendor payloads. Nothing is inferred."""

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_LONG, _STRING, _DOUBLE = T.LongType(), T.StringType(), T.DoubleType()
_TIME, _BOOL = T.TimestampType(), T.BooleanType()

TABLES = {
    "users": _table(("id", _LONG), ("username", _STRING), ("email", _STRING), ("created_at", _TIME)),
    "holdings": _table(
        ("id", _LONG), ("user_id", _LONG), ("symbol", _STRING), ("quantity", _LONG),
        ("average_price", _DOUBLE), ("last_updated", _TIME),
    ),
    "trades": _table(
        ("id", _LONG), ("user_id", _LONG), ("symbol", _STRING), ("transaction_type", _STRING),
        ("quantity", _LONG), ("price", _DOUBLE), ("timestamp", _TIME),
    ),
    "chat_sessions": _table(
        ("id", _LONG), ("user_id", _LONG), ("session_id", _STRING), ("created_at", _TIME),
        ("last_interaction", _TIME),
    ),
    "chat_messages": _table(
        ("id", _LONG), ("session_id", _STRING), ("message", _STRING), ("is_user", _BOOL),
        ("timestamp", _TIME),
    ),
}

# Vendor payloads, as Spark DDL for from_json.
DAILY_SERIES_JSON = "`Time Series (Daily)` map<string, map<string, string>>"
QUOTE_A_JSON = "`Global Quote` map<string, string>"
QUOTE_B_JSON = "map<string, string>"
SEARCH_JSON = "bestMatches array<map<string, string>>"
NEWS_A_JSON = (
    "status string, articles array<struct<title: string, url: string, source: struct<name: string>, "
    "publishedAt: string, description: string>>"
)
NEWS_B_JSON = "array<struct<headline: string, url: string, source: string, datetime: bigint, summary: string>>"
ITEM_LIST_JSON = "array<map<string, string>>"
OVERVIEW_JSON = "map<string, string>"
