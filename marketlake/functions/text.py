"""Ordered keyword rules over text, as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake import lookups
from marketlake.functions.scalars import template

def faq_answer(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The answer of the first rule, in list order, whose keyword occurs in the lower-cased text."""
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(word)), F.lit(answer)) for word, answer in rules]
    return F.coalesce(*hits, F.lit(default))


def faq_match(
    df: DataFrame,
    text: str = "message",
    rules: Sequence[tuple[str, str]] = lookups.FAQ,
    default: str = lookups.FAQ_DEFAULT,
) -> DataFrame:
    return df.withColumn("response", faq_answer(F.col(text), rules, default))


def sentiment_tag(text: Column) -> Column:
    """'Bullish' wins over 'Bearish'; neither word gives 'Neutral'."""
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("bullish")), "Bullish")
        .when(F.contains(low, F.lit("bearish")), "Bearish")
        .otherwise("Neutral")
    )


def topic_tags(
    query: Column,
    rules: Sequence[tuple[str, str]] = lookups.TOPIC_KEYWORDS,
    every: Sequence[str] = lookups.TOPICS,
) -> Column:
    """Categories of all keywords in the query, repeats kept; all categories when none occurs."""
    low = F.lower(query)
    hits = F.array_compact(
        F.array(*[F.when(F.contains(low, F.lit(word)), F.lit(tag)) for word, tag in rules])
    )
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(*[F.lit(t) for t in every]))


def analysis_prompt(
    symbol: Column,
    data: Column | None,
    system_text: str,
    closing: str,
) -> Column:
    """The caller's system text about a symbol (``%s``), with the data as JSON where there is any, and a closing."""
    head = template(system_text, symbol)
    if data is None:
        return F.concat(head, F.lit(closing))
    block = F.concat(template(lookups.DATA_LEAD, symbol), F.to_json(data), F.lit("\n\n"))
    return F.concat(head, F.when(data.isNotNull(), block).otherwise(""), F.lit(closing))


def company_overview(df: DataFrame) -> DataFrame:
    """Opening paragraph from the company columns; null where the sector is unknown."""
    text = template(
        lookups.OVERVIEW, *[F.col(c) for c in ("name", "symbol", "name", "sector", "business", "products")])
    return df.withColumn("overview", text)
