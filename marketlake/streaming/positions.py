"""Holdings out of a stream of trades: each micro-batch is folded by the batch operator onto what is held.

So a position that has a third of a batch is cut into blocks and folded by many tasks, and a worker holds no more than in
batch. What is held is one row per position with the place of its last trade, as versions by batch number (``newest``), so a batch
that is run again starts from the same positions and writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marketlake.operators.ledger import KEY, TRADE, fold_trades
from marketlake.operators.ledger import _fault as fault
from marketlake.session import stored
from marketlake.streaming import newest

LATE = "late"
RULE = newest.Rule(tuple(KEY), ("seq",))


def _schema(spark: SparkSession) -> StructType:
    return spark.createDataFrame([], "user_id bigint, symbol string, quantity bigint, average_price double, last_updated timestamp, "
                                     "at timestamp, last_id bigint, seq bigint").schema


def _state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    return newest.current(spark, f"{root}/state", _schema(spark), RULE, before)


def settle(batch: DataFrame, number: int, root: str, opening: DataFrame | None = None, compact: int = newest.COMPACT, **fold) -> None:
    """One micro-batch: the positions that it touches, and the trades that it refuses."""
    spark = batch.sparkSession
    rows = stored(batch.select(*TRADE), "trades")
    touched = rows.select(*KEY).distinct()
    held = touched.join(_state(spark, root, number), KEY, "left")
    if opening is not None:
        first = opening.select(*KEY, F.col("quantity").alias("q0"), F.col("average_price").alias("a0"), F.col("last_updated").alias("t0"))
        seen = F.col("seq").isNotNull()
        held = held.join(first, KEY, "left").withColumns({
            "quantity": F.when(seen, F.col("quantity")).otherwise(F.col("q0")), "average_price": F.when(seen, F.col("average_price")).otherwise(F.col("a0")),
            "last_updated": F.when(seen, F.col("last_updated")).otherwise(F.col("t0"))})
    held = stored(held.select(*KEY, "quantity", "average_price", "last_updated", "at", "last_id"), "held")
    marked = rows.join(held.select(*KEY, "at", "last_id"), KEY, "left").withColumn("_sound", fault().isNull()).withColumn(
        "_late", F.col("_sound") & F.coalesce(F.struct("timestamp", "id") <= F.struct(F.col("at").alias("timestamp"), F.col("last_id").alias("id")), F.lit(False))
        & F.col("at").isNotNull())
    marked = stored(marked.select(*TRADE, "_sound", "_late"), "marked")  # once, for the fold, the late trades and the ends
    on_time = marked.filter(~F.col("_late"))
    done = fold_trades(on_time.select(*TRADE), held.filter("quantity > 0").select(*KEY, "quantity", "average_price", "last_updated"), **fold)
    late = marked.filter("_late").select(*TRADE, F.lit(LATE).alias("reason"))
    done.rejected.select(*TRADE, "reason").unionByName(late).write.mode("overwrite").parquet(f"{root}/rejected/batch={number:012d}")
    ends = on_time.filter("_sound").groupBy(*KEY).agg(F.max(F.struct("timestamp", "id")).alias("end"))
    now = held.select(*KEY, "at", "last_id").join(done.holdings, KEY, "left").join(ends, KEY, "left").select(
        *KEY, F.coalesce("quantity", F.lit(0).cast("bigint")).alias("quantity"), "average_price", "last_updated",
        F.coalesce("end.timestamp", "at").alias("at"), F.coalesce("end.id", "last_id").alias("last_id"), F.lit(number).cast("bigint").alias("seq"))
    newest.settle(stored(now, "positions"), number, f"{root}/state", RULE, compact)


def start(trades: DataFrame, root: str, checkpoint: str, opening: DataFrame | None = None, interval: str | None = None,
          compact: int = newest.COMPACT, **fold) -> StreamingQuery:
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        trades.writeStream.foreachBatch(lambda batch, number: settle(batch, number, root, opening, compact, **fold))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def current(spark: SparkSession, root: str, opening: DataFrame | None = None) -> DataFrame:
    """One row per open position; with ``opening``, also those of it that were never traded."""
    state = _state(spark, root)
    cols = [*KEY, "quantity", "average_price", "last_updated"]
    now = state.filter("quantity > 0").select(*cols)
    return now if opening is None else now.unionByName(opening.join(state.select(*KEY), KEY, "left_anti").filter("quantity > 0").select(*cols))


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """The refused trades with their reason: those of the batch fold, and sound trades older than their position's last."""
    kinds = "id bigint, user_id bigint, symbol string, transaction_type string, quantity bigint, price double, timestamp timestamp, reason string"
    rows = spark.read.schema(kinds + ", batch bigint").option("basePath", f"{root}/rejected").parquet(f"{root}/rejected")
    marks = spark.read.schema(newest.MARK).parquet(f"{root}/state/marks")
    return rows.join(marks.select("batch").distinct(), "batch", "left_semi").drop("batch")
