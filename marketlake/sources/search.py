"""Symbol search answers and company snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.scalars import trailing_pct_to_double
from marketlake.operators.relational import enrich_quotes, overview_quote
from marketlake.schemas import OVERVIEW_JSON, QUOTE_A_JSON, SEARCH_JSON


def search_matches(raw: DataFrame, k: int | None = 10, payload: str = "payload") -> DataFrame:
    """The first ``k`` matches of each answer, or all of them, in the provider's order."""
    matches = F.from_json(payload, SEARCH_JSON)["bestMatches"]
    read = raw.select("query", F.posexplode(matches if k is None else F.slice(matches, 1, k)))
    return read.select(
        "query", F.col("pos").alias("rank"),
        F.try_element_at("col", F.lit("1. symbol")).alias("symbol"),
        F.try_element_at("col", F.lit("2. name")).alias("company_name"),
        F.try_element_at("col", F.lit("4. region")).alias("region"),
        F.try_element_at("col", F.lit("8. currency")).alias("currency"))


def search_quotes(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Provider quotes as the search reads them: trailing percent signs dropped, all three figures needed."""
    q = F.from_json(payload, QUOTE_A_JSON)["Global Quote"]
    return raw.select("symbol", q.alias("q")).select(
        "symbol",
        F.try_element_at("q", F.lit("05. price")).try_cast("double").alias("price"),
        F.try_element_at("q", F.lit("09. change")).try_cast("double").alias("change"),
        trailing_pct_to_double(F.try_element_at("q", F.lit("10. change percent"))).alias("change_percent"),
    ).dropna()


def symbol_search(raw: DataFrame, quotes: DataFrame, k: int = 10) -> DataFrame:
    """Search answers with the quote of each match, in one join."""
    return enrich_quotes(search_matches(raw, k), quotes)


def company_snapshot(overview: DataFrame, quotes: DataFrame, payload: str = "payload") -> DataFrame:
    """Overview and quote of a symbol, only where the overview names its symbol and the quote is there.

    ``quotes`` are provider answers (symbol, payload); an empty quote object still counts as present.
    """
    facts = overview.select("symbol", F.from_json(payload, OVERVIEW_JSON).alias("overview")).filter(
        F.map_contains_key("overview", F.lit("Symbol")))
    quote = quotes.select("symbol", F.from_json(payload, QUOTE_A_JSON)["Global Quote"].alias("quote")).filter(
        F.col("quote").isNotNull())
    return overview_quote(facts, quote)
