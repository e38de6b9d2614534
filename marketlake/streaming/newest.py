"""The newest row of each key, out of a stream in any order.

Every micro-batch is cut to one row per key before its shuffle, so a hot key is no burden, and meets what is held: a row
goes on only if it is newer than all before it, however late it comes. What wins is written under the batch's number, so
a batch that is run again writes the same again. Held are a base, one row per key, and the winners since; after
``COMPACT`` batches they become the next base. A reader takes the base and the few winners after it, never the whole log.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

COMPACT = 16
MARK = "batch bigint, kind string, path string"


class Rule(NamedTuple):
    """What tells rows of a key apart: the columns of the key, and numbers of which the larger one is newer."""

    key: tuple[str, ...]
    rank: tuple[str, ...]  # SQL expressions, the first one decides; ties go to the larger values in the order of the columns


def newest(rows: DataFrame, rule: Rule) -> DataFrame:
    """One row per key. The maximum is taken before the shuffle."""
    value = [c for c in rows.columns if c not in rule.key]
    rank = [F.expr(e).alias(f"_rank_{i}") for i, e in enumerate(rule.rank)]
    best = rows.groupBy(*rule.key).agg(F.max(F.struct(*rank, *value)).alias("_best"))
    return best.select(*rule.key, *[F.col("_best")[c].alias(c) for c in value]).select(*rows.columns)


def _marks(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MARK).parquet(f"{root}/marks")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def _mark(spark: SparkSession, root: str, batch: int, kind: str, path: str) -> None:
    spark.createDataFrame([(batch, kind, path)], MARK).coalesce(1).write.mode("append").parquet(f"{root}/marks")


def _held(spark: SparkSession, root: str, before: int | None = None) -> tuple[list[str], int]:
    """The folders that hold the state before a batch: the newest base and the winners since, and how many these are."""
    marks = _marks(spark, root)
    if marks is None:
        return [], 0
    if before is not None:
        marks = marks.filter(F.col("batch") < before)
    base = marks.filter("kind = 'base'").agg(F.max_by("path", "batch"), F.max("batch")).first()
    since = marks.filter("kind = 'won'").filter(F.col("batch") > (base[1] if base[1] is not None else -1))
    won = [r["path"] for r in since.select("path").distinct().orderBy("path").collect()]  # at most COMPACT
    return ([base[0]] if base[0] else []) + won, len(won)


def _read(spark: SparkSession, paths: Sequence[str], schema: StructType) -> DataFrame:
    parts = [spark.read.schema(schema).parquet(p) for p in paths]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def settle(batch: DataFrame, number: int, root: str, rule: Rule, compact: int = COMPACT) -> None:
    """One micro-batch: write the rows that win, and a new base now and then."""
    spark, schema = batch.sparkSession, batch.schema
    paths, n = _held(spark, root, number)
    held = newest(_read(spark, paths, schema), rule)
    rank: list[Column] = [F.expr(e) for e in rule.rank]
    value = [c for c in batch.columns if c not in rule.key]
    came = newest(batch, rule).withColumn("_came", F.struct(*rank, *value))
    before = held.withColumn("_before", F.struct(*rank, *value)).select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(rule.key)], "_before")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(rule.key)])
    wins = came.join(before, same, "left").filter(F.col("_before").isNull() | (F.col("_came") > F.col("_before"))).select(*batch.columns)
    won = f"{root}/won/batch={number:012d}"
    wins.write.mode("overwrite").parquet(won)
    _mark(spark, root, number, "won", won)
    if n + 1 >= compact:
        base = f"{root}/base/upto={number:012d}"
        newest(_read(spark, [*paths, won], schema), rule).write.mode("overwrite").parquet(base)
        _mark(spark, root, number, "base", base)


def start(stream: DataFrame, root: str, checkpoint: str, rule: Rule, interval: str | None = None, compact: int = COMPACT) -> StreamingQuery:
    """Keep ``root`` up to date from a stream; without an interval it takes what is there and ends."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(lambda batch, number: settle(batch, number, root, rule, compact))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def current(spark: SparkSession, root: str, schema: StructType, rule: Rule, before: int | None = None) -> DataFrame:
    """One row per key: the base and the winners since. Empty before the first batch; ``before`` goes back to a batch."""
    return newest(_read(spark, _held(spark, root, before)[0], schema), rule)


def winners(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All rows that won when they came, with the number of their ``batch``."""
    marks = _marks(spark, root)
    if marks is None:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).option("basePath", f"{root}/won").parquet(f"{root}/won")
    return rows.join(marks.filter("kind = 'won'").select("batch").distinct(), "batch", "left_semi").select(*schema.names, "batch")
