"""Substring rules: which of many patterns occur in a text.

Patterns are literals, tested on lower-cased text. Up to ``FEW`` patterns are one array, a subquery's result (for a stream
a table of one row), that every text is tested with. More meet the texts in an inverted gram join: a pattern is filed under one of its grams (runs of
``GRAM`` characters, or all of a shorter pattern), the one that the fewest patterns have; a text looks up its distinct
grams, and what it finds is confirmed with ``contains``. So the work grows with the texts and with what is found, never
with texts times patterns, and everything is a DataFrame expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.session import stored

FEW = 64
GRAM = 3
#: Patterns of up to so many bytes (with what a row of a hash table takes) are sent to all executors.
BROADCAST_BYTES = 128_000_000
ROW_BYTES = 200


def _grams(text: Column, size: int) -> Column:
    """All runs of so many characters, one from every place on."""
    if size == 0:
        return F.array(F.lit(""))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def _text_grams(text: Column, sizes: Sequence[int]) -> Column:
    """A text's grams of all sizes: the largest ones are cut from the text, smaller ones from these and from its end."""
    if not sizes:
        return F.array().cast("array<string>")
    most = max(sizes)
    large = F.array_distinct(_grams(text, most))
    rest = F.right(text, F.lit(max(most - 1, 0)))

    def cut(size: int) -> list[Column]:
        return [F.transform(large, lambda g: F.substring(g, 1, size)), _grams(rest, size)]

    return F.concat(large, *[part for n in sizes if n < most for part in cut(n)])


def _filed(rules: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Each pattern (``_key``, ``_pattern``) with the gram (``_gram``) that it is filed under."""
    length = F.least(F.length("_pattern"), F.lit(GRAM))
    grams = F.array().cast("array<string>")
    for size in sizes:
        grams = F.when(length == size, _grams(F.col("_pattern"), size)).otherwise(grams)
    every = rules.select("_key", "_pattern", F.explode(F.array_distinct(grams)).alias("_gram"))
    shared = every.groupBy("_gram").agg(F.count("*").alias("_shared"))
    rarest = F.min(F.struct("_shared", "_gram"))["_gram"].alias("_gram")
    return every.join(shared, "_gram").groupBy("_key", "_pattern").agg(rarest)


def matches(df: DataFrame, text_cols: Sequence[str], patterns: DataFrame, key: str, pattern: str,
            few: int = FEW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per (row of ``df``, pattern that occurs in any of the text columns); adds ``key``.

    ``patterns`` holds a unique ``key`` (bigint) and the ``pattern`` text. A null text counts as empty; a null pattern
    occurs nowhere, an empty one everywhere. The patterns' size is measured first: up to ``broadcast_bytes`` they go to
    the texts, which are read once and not shuffled. More of them meet (row, gram) pairs by a shuffle join, and the texts
    join what was found (a stream meets them with its texts).
    """
    rules = patterns.select(F.col(key).cast("bigint").alias("_key"), F.lower(pattern).alias("_pattern")).filter("_pattern is not null")
    size = F.least(F.length("_pattern"), F.lit(GRAM))
    measured = rules.agg(F.sort_array(F.collect_set(size)).alias("sizes"),
                         F.coalesce(F.sum(F.octet_length("_pattern") + ROW_BYTES), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    lows = {c: f"_low_{i}" for i, c in enumerate(text_cols)}
    low = df.withColumns({name: F.lower(F.coalesce(F.col(c), F.lit(""))) for c, name in lows.items()})
    kept = [*[c for c in df.columns if c != key], key]
    if measured["n"] <= few:
        told = rules.agg(F.collect_list(F.struct("_key", "_pattern")).alias("_rules"))
        # A stream takes no subquery, so it meets the table of one row.
        low = low.crossJoin(F.broadcast(told)) if df.isStreaming else low.withColumn("_rules", told.scalar())
        hits = F.filter("_rules", lambda r: _any([F.contains(F.col(c), r["_pattern"]) for c in lows.values()]))
        return low.withColumn("_rule", F.explode(hits)).withColumn(key, F.col("_rule._key")).select(*kept)
    filed = _filed(rules, measured["sizes"])
    grams = F.array_distinct(F.concat(*[_text_grams(F.col(c), measured["sizes"]) for c in lows.values()]))
    hit = _any([F.contains(F.col(c), F.col("_pattern")) for c in lows.values()])
    if measured["bytes"] <= broadcast_bytes or df.isStreaming:
        told = F.broadcast(filed) if measured["bytes"] <= broadcast_bytes else filed
        found = low.withColumn("_gram", F.explode(grams)).join(told, "_gram").filter(hit)
    else:
        rows = stored(low.withColumn("_row", F.monotonically_increasing_id()), "texts")  # written, so that ids stay
        pairs = rows.select("_row", F.explode(grams).alias("_gram")).join(filed, "_gram").select("_row", "_key", "_pattern")
        found = rows.join(pairs, "_row").filter(hit)
    return found.withColumn(key, F.col("_key")).select(*kept)


def match_rules(df: DataFrame, text_col: str, rules: DataFrame, **kw) -> DataFrame:
    """Each row with each rule (priority, keyword, ...) whose keyword occurs in its text."""
    hit = matches(df, [text_col], rules, "priority", "keyword", **kw)
    return hit.join(rules, "priority")


def news_search(news: DataFrame, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
    """For every query (query_id, query): the first ``k`` articles, by arrival, with it in headline or summary.

    Equal queries are searched once. Only (pattern, arrival) pairs are ranked, and each task cuts them to
    ``k`` per pattern before the shuffle, so a pattern that fits most articles moves few and narrow rows;
    the article columns join the few winners by their unique ``arrival``.
    """
    asked = queries.select("query_id", F.lower("query").alias("_pattern"))
    patterns = asked.groupBy("_pattern").agg(F.min("query_id").alias("_key"))
    hit = matches(
        news.select("arrival", "headline", "summary"), ["headline", "summary"], patterns, "_key", "_pattern", **kw)
    order = F.row_number().over(Window.partitionBy("_key").orderBy("arrival"))
    first = hit.select("_key", "arrival").withColumn("rank", order).filter(F.col("rank") <= k)
    found = first.join(patterns, "_key").join(asked, "_pattern").select("query_id", "rank", "arrival")
    return news.join(found, "arrival")
