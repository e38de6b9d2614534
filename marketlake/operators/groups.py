"""Ordered work per key that stays bounded when one key holds much of the table.

A window or a sorted fold puts all rows of a key into one task. Here the keys with more rows than
``hot_rows`` are found by a count (combined before its shuffle), and only those are cut into blocks:
a range exchange on (key, order) spreads a hot key over many tasks, each row gets its exact place in
that order, and a block is a run of places. What a block needs from the rows before it comes either
as lead-in rows (:func:`by_group`) or as a carried value (see ``chat`` and ``ledger``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.session import settled, stored

HOT_ROWS = 1_000_000
BLOCK_ROWS = 262_144
TASK_ROWS = 2_000_000
BROADCAST_KEYS = 100_000

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


class Split(NamedTuple):
    """Rows of ordinary keys and rows of hot keys; ``hot`` is None when there is no hot key."""

    calm: DataFrame
    longest: int  # rows of the largest ordinary key
    hot: DataFrame | None
    hot_total: int


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> Split:
    """Part the rows by whether their key has more than ``hot_rows`` rows."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = F.col("_rows") > hot_rows
    found = sizes.agg(
        F.count_if(hot).alias("n"), F.sum(F.when(hot, F.col("_rows"))).alias("rows"),
        F.max(F.when(~hot, F.col("_rows"))).alias("longest")).first()
    if found["n"] == 0:
        return Split(df, found["longest"] or 0, None, 0)
    names = settled(sizes.filter(hot).select(*keys))
    if found["n"] <= BROADCAST_KEYS:
        names = F.broadcast(names)
    return Split(
        df.join(names, list(keys), "left_anti"), found["longest"] or 0,
        df.join(names, list(keys), "left_semi"), found["rows"])


def with_places(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], total: int, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Add ``_place``: the exact rank of each row in the order (keys, order), without one big task.

    The sorted copy is written out because both the partition sizes (one narrow column) and the rows are
    read from it and the range bounds must not move in between. Each row keeps its number, so the order
    of the files does not matter.
    """
    parts = max(1, math.ceil(total / task_rows))
    by = [*[F.col(k) for k in keys], *order]
    laid = stored(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .withColumn("_row", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_row", _ROW_BITS)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        laid.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("_place", F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_row", "_part", "_start")
    )


def by_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    fn: Callable[[DataFrame, list[str], list[Column], int], DataFrame],
    lead_in: int,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``fn(frame, group columns, order, rows of the largest group)`` on bounded groups.

    A row may need at most ``lead_in`` rows before it. Blocks of hot keys are led by the last ``lead_in`` rows of the block before; those rows are
    dropped from the result, so it is the same as that of an unsplit window.
    """
    split = split_hot(df, keys, hot_rows)
    calm = fn(split.calm, list(keys), list(order), split.longest)
    if split.hot is None:
        return calm
    size = max(block_rows, 2 * lead_in)
    placed = with_places(split.hot, keys, order, split.hot_total)
    block = F.floor(F.col("_place") / size)
    ends = F.col("_place") % size >= size - lead_in
    blocks = placed.withColumn("_home", block).withColumn(
        "_block",
        F.explode(F.when(ends, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))),
    )
    done = fn(blocks, [*keys, "_block"], [F.col("_place")], size + lead_in).filter(F.col("_block") == F.col("_home"))
    return calm.unionByName(done.drop("_place", "_home", "_block"))
