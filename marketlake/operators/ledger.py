"""Trade ledger: average-cost holdings per (user, symbol), with refused sells reported apart.

A BUY raises the quantity and re-weights the average cost. A SELL needs enough shares, leaves the
average alone, and closes the position at zero, so that the next BUY starts a new average. Which sells
are refused depends on the path, so the trades of a position are folded in order. A trade whose
quantity is not positive is refused outright.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake import lookups
from marketlake.operators.groups import split_hot, with_places
from marketlake.session import settled, stored

ARRAY_ROWS = 16_384  # a position of up to so many trades is folded as one array
BLOCK_ROWS = 500_000  # a longer one in blocks of so many trades
LEVEL = 4_096  # block summaries combined in one array

KEY = ["user_id", "symbol"]
SPOT = [*KEY, "block"]
TRADE = ["id", "user_id", "symbol", "transaction_type", "quantity", "price", "timestamp"]

BAD_QUANTITY = "bad_quantity"
BAD_PRICE = "bad_price"
BAD_TYPE = "bad_transaction_type"


class Fold(NamedTuple):
    holdings: DataFrame  # user_id, symbol, quantity, average_price, last_updated
    rejected: DataFrame  # the trade columns and reason


def _fault() -> Column:
    """Why a trade is refused whatever the position is; a type that is no type comes first."""
    return (
        F.when(~F.coalesce(F.col("transaction_type").isin("BUY", "SELL"), F.lit(False)), BAD_TYPE)
        .when(F.coalesce(F.col("quantity") <= 0, F.lit(True)), BAD_QUANTITY)
        .when(F.col("price").isNull(), BAD_PRICE)
    )


def _checked(trades: DataFrame) -> DataFrame:
    fault = _fault()
    return trades.select(*TRADE).select(
        "id", *KEY, F.coalesce(F.col("transaction_type") == "BUY", F.lit(False)).alias("buy"), "quantity", "price",
        "timestamp", F.when(fault == BAD_TYPE, F.col("transaction_type")).alias("odd_type"), fault.alias("fault"))


def _entry() -> Column:
    return F.struct(
        F.col("timestamp").alias("at"), "id", "buy", "quantity", "price", "odd_type", "fault")


_ENTRY = (
    "struct<at: timestamp, id: bigint, buy: boolean, quantity: bigint, price: double, odd_type: string, fault: string>"
)


def _step(acc: Column, t: Column) -> Column:
    """One trade on a position."""
    have, n = acc["quantity"], t["quantity"]
    refused = t["fault"].isNotNull() | ((~t["buy"]) & (have < n))
    total = have + n
    return F.struct(
        F.when(refused, have).when(t["buy"], total).otherwise(have - n).alias("quantity"),
        F.when(refused | ~t["buy"], acc["average"]).when(have == 0, t["price"])
        .otherwise((have * acc["average"] + n * t["price"]) / total).alias("average"),
        F.when(refused, acc["touched"]).otherwise(t["at"]).alias("touched"),
        F.when(refused, F.array_append(acc["refused"], t)).otherwise(acc["refused"]).alias("refused"),
    )


def _folded(quantity: Column, average: Column, touched: Column) -> Column:
    start = F.struct(
        quantity.cast("bigint").alias("quantity"), average.cast("double").alias("average"),
        touched.cast("timestamp").alias("touched"),
        F.array().cast(f"array<{_ENTRY}>").alias("refused"),
    )
    return F.aggregate("trades", start, _step)


def _opening(opening: DataFrame | None) -> DataFrame | None:
    if opening is None:
        return None
    return opening.select(
        *KEY, F.col("quantity").alias("q0"), F.col("average_price").alias("a0"), F.col("last_updated").alias("t0"))


def _with_opening(df: DataFrame, opening: DataFrame | None, how: str) -> DataFrame:
    start = _opening(opening)
    if start is None:
        return df.withColumns({
            "q0": F.lit(0).cast("bigint"), "a0": F.lit(0.0), "t0": F.lit(None).cast("timestamp")})
    return df.join(start, KEY, how).withColumns({
        "q0": F.coalesce("q0", F.lit(0)), "a0": F.coalesce("a0", F.lit(0.0))})


def _holdings(df: DataFrame) -> DataFrame:
    return df.filter(F.col("quantity") > 0).select(*KEY, "quantity", "average_price", "last_updated")


def _rejects(df: DataFrame) -> DataFrame:
    return df.select(*KEY, F.explode("refused").alias("t")).select(
        "t.id", *KEY, _type("t."), "t.quantity", "t.price", F.col("t.at").alias("timestamp"), _reason("t."))


def _type(of: str = "") -> Column:
    """A trade's type: only one that is neither BUY nor SELL is kept as text."""
    known = F.when(F.col(f"{of}buy"), "BUY").otherwise("SELL")
    return F.when(F.col(f"{of}fault") == BAD_TYPE, F.col(f"{of}odd_type")).otherwise(known).alias("transaction_type")


def _reason(of: str = "") -> Column:
    return F.coalesce(f"{of}fault", F.lit(lookups.NOT_ENOUGH_SHARES)).alias("reason")


def _fold_calm(trades: DataFrame, opening: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Fold each position as one sorted array of bounded length; the result feeds holdings and rejects."""
    grouped = trades.groupBy(*KEY).agg(F.array_sort(F.collect_list(_entry())).alias("trades"))
    ready = _with_opening(grouped, opening, "left").select(
        *KEY, _folded(F.col("q0"), F.col("a0"), F.col("t0")).alias("s"))
    state = stored(ready.select(
        *KEY, F.col("s.quantity").alias("quantity"), F.col("s.average").alias("average_price"),
        F.col("s.touched").alias("last_updated"), F.col("s.refused").alias("refused")), "positions")
    return state.drop("refused"), _rejects(state)


def _entries(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[bool], list[int]]:
    """A block's trades in order, and its sides and quantities as plain lists."""
    pdf = pdf.sort_values("_place")
    return pdf, pdf["buy"].tolist(), pdf["quantity"].tolist()


def _through(have: int, buys: list[bool], quantities: list[int]) -> int:
    """Shares left after a block that is entered with ``have``."""
    for buy, n in zip(buys, quantities):
        if buy:
            have += n
        elif have >= n:
            have -= n
    return have


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's net change, the shares it needs to refuse nothing, and where it ends from zero."""
    pdf, buys, quantities = _entries(pdf)
    level = pdf["quantity"].where(pdf["buy"], -pdf["quantity"]).cumsum()
    return pdf.iloc[:1][SPOT].assign(
        net=level.iloc[-1], need=max(0, -level.min()), seen_in=0, seen_out=_through(0, buys, quantities))


def _passed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where a block ends from the shares it is now thought to be entered with."""
    pdf, buys, quantities = _entries(pdf)
    entered = int(pdf["entered"].iloc[0])
    return pdf.iloc[:1][SPOT].assign(seen_in=entered, seen_out=_through(entered, buys, quantities))


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chain the block summaries of one position.

    A block entered with at least ``need`` shares refuses nothing, so its net change settles it. Any
    other block counts as known only if it was folded from exactly this quantity; where it was not, its
    last known outcome is the guess for the blocks after it and it is marked.
    """
    pdf = pdf.sort_values("block")
    have, entered, todo = int(pdf["q0"].iloc[0]), [], []
    for need, net, seen_in, seen_out in zip(*[pdf[c].tolist() for c in ("need", "net", "seen_in", "seen_out")]):
        entered.append(have)
        enough = have >= need
        todo.append(not enough and seen_in != have)
        have = have + net if enough else seen_out
    return pdf[SPOT].assign(entered=entered, todo=todo)


def _closed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fold a block whose entry quantity is settled: its outcome, and the places of its refused trades.

    The average after the block is ``average + slope`` times the average before it. Trades stay outside: a
    column with a null would come here as doubles, which do not hold every id.
    """
    pdf, buys, quantities = _entries(pdf)
    have, average, slope, kept, refused = int(pdf["entered"].iloc[0]), 0.0, 1.0, -1, []
    places = pdf["_place"].tolist()
    for i, (buy, n, price, fault) in enumerate(
            zip(buys, quantities, pdf["price"].tolist(), pdf["faulty"].tolist())):
        if fault or (not buy and have < n):
            refused.append(places[i])
        elif buy:
            total = have + n
            average = (have * average + n * price) / total if have else price
            slope = slope * have / total
            have, kept = total, i
        else:
            have, kept = have - n, i
    end = pdf.iloc[:1][SPOT].assign(
        held=have, average=average, slope=slope, touched=pdf["timestamp"].iloc[kept] if kept >= 0 else pd.NaT)
    return end.assign(refused=[refused])


def _fold_hot(
    trades: DataFrame, opening: DataFrame | None, total: int, block_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Fold long positions block by block, all blocks at once, until the chain of blocks agrees.

    Each round folds, in parallel, the blocks whose entry quantity was a wrong guess. The first of
    them in a position is right afterwards, so the rounds end. They end early because a block that
    never runs short needs no fold, and one that does forgets its entry quantity: from any two of them
    the quantities meet after about as many trades as there are shares in the largest trade.
    """
    kinds = {f.name: f.dataType.simpleString() for f in trades.schema}
    spot = f"user_id {kinds['user_id']}, symbol {kinds['symbol']}, block bigint"
    placed = with_places(trades, KEY, [F.col("timestamp"), F.col("id")], total)
    rows = placed.withColumn("block", F.floor(F.col("_place") / block_rows))
    sound = F.when(F.col("fault").isNull(), F.col("quantity")).otherwise(0)  # a faulty trade moves nothing
    plain = rows.select(*SPOT, "_place", "buy", sound.alias("quantity"))
    summary = settled(_with_opening(plain.groupBy(*SPOT).applyInPandas(
        _summed, f"{spot}, net bigint, need bigint, seen_in bigint, seen_out bigint"), opening, "left"))
    while True:
        walked = settled(summary.groupBy(*KEY).applyInPandas(_walk, f"{spot}, entered bigint, todo boolean"))
        todo = walked.filter("todo").drop("todo")
        if todo.isEmpty():
            break
        again = plain.join(todo, SPOT).groupBy(*SPOT).applyInPandas(
            _passed, f"{spot}, seen_in bigint, seen_out bigint")
        fixed = summary.drop("seen_in", "seen_out").join(again, SPOT)
        summary = settled(summary.join(todo, SPOT, "left_anti").unionByName(fixed))
    told = rows.select(*SPOT, "_place", "buy", sound.alias("quantity"), "price", "timestamp",
                       F.col("fault").isNotNull().alias("faulty"))
    done = stored(told.join(walked.drop("todo"), SPOT).groupBy(*SPOT).applyInPandas(
        _closed, f"{spot}, held bigint, average double, slope double, touched timestamp, refused array<bigint>"), "blocks")
    places = done.select(*KEY, F.explode("refused").alias("_place"))
    refused = rows.join(places, [*KEY, "_place"], "left_semi").select(
        "id", *KEY, _type(), "quantity", "price", "timestamp", _reason())
    ends = done.select(*SPOT, F.col("held").alias("quantity"), "average", "slope", "touched")
    return _joined(ends, opening), refused


def _joined(done: DataFrame, opening: DataFrame | None) -> DataFrame:
    """Combine the blocks of a position: the average is a straight line in the average before it."""
    link = F.struct("block", "quantity", "average", "slope", "touched")
    parts = done.select(*KEY, link.alias("link"), F.floor(F.col("block") / LEVEL).alias("upper"))
    for by in ([*KEY, "upper"], KEY):
        parts = parts.groupBy(*by).agg(F.array_sort(F.collect_list("link")).alias("links")).select(
            *by, F.aggregate(
                F.slice("links", 2, F.greatest(F.size("links") - 1, F.lit(0))), F.element_at("links", 1),
                lambda acc, x: F.struct(
                    x["block"].alias("block"), x["quantity"].alias("quantity"),
                    (x["average"] + x["slope"] * acc["average"]).alias("average"),
                    (x["slope"] * acc["slope"]).alias("slope"),
                    F.coalesce(x["touched"], acc["touched"]).alias("touched"))).alias("link"))
    return _with_opening(parts, opening, "left").select(
        *KEY, F.col("link.quantity").alias("quantity"),
        (F.col("link.average") + F.col("link.slope") * F.col("a0")).alias("average_price"),
        F.coalesce("link.touched", "t0").alias("last_updated"))


def fold_trades(trades: DataFrame, opening: DataFrame | None = None, array_rows: int = ARRAY_ROWS,
                block_rows: int = BLOCK_ROWS) -> Fold:
    """Fold trades, by (timestamp, id), onto the opening holdings."""
    split = split_hot(_checked(trades), KEY, array_rows)
    state, rejected = _fold_calm(split.calm, opening)
    if split.hot is not None:
        hot_state, hot_rejected = _fold_hot(split.hot, opening, split.hot_total, block_rows)
        state, rejected = state.unionByName(hot_state), rejected.unionByName(hot_rejected)
    if opening is not None:  # positions that were not traded stay as they are
        idle = opening.join(state.select(*KEY), KEY, "left_anti")
        state = state.unionByName(idle.select(*KEY, "quantity", "average_price", "last_updated"))
    return Fold(_holdings(state), rejected)


def merge_buys(opening: DataFrame, buys: DataFrame) -> DataFrame:
    """Average cost after buys only: sums combine before the shuffle and in any order."""
    lots = buys.groupBy(*KEY).agg(
        F.sum("quantity").alias("bought"), F.sum(F.col("quantity") * F.col("price")).alias("paid"))
    q0, paid0 = F.coalesce("quantity", F.lit(0)), F.coalesce(F.col("quantity") * F.col("average_price"), F.lit(0.0))
    total = q0 + F.coalesce("bought", F.lit(0))
    return (
        opening.select(*KEY, "quantity", "average_price").join(lots, KEY, "full")
        .select(*KEY, total.alias("quantity"),
                F.try_divide(paid0 + F.coalesce("paid", F.lit(0.0)), total).alias("average_price"))
    )


class Applied(NamedTuple):
    holdings: DataFrame
    accepted: DataFrame
    rejected: DataFrame


def apply_trades(holdings: DataFrame, trades: DataFrame, **kw) -> Applied:
    """The next version of the holdings, the trades to append, and the trades refused."""
    fold = fold_trades(trades, holdings, **kw)
    rejected = stored(fold.rejected, "rejected")
    accepted = trades.select(*TRADE).join(rejected.select("id"), "id", "left_anti").select(*TRADE)
    return Applied(fold.holdings, accepted, rejected)


def write_version(holdings: DataFrame, root: str, version: int) -> str:
    """Write holdings as a new version, then add it to the log that readers go by.

    A version that may be being read is never overwritten, and one whose writing failed is never seen.
    """
    path = f"{root}/holdings/version={version:012d}"
    holdings.write.mode("overwrite").parquet(path)
    row = holdings.sparkSession.createDataFrame([(version, path)], "version bigint, path string")
    row.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The newest logged version of the holdings."""
    newest = spark.read.schema("version bigint, path string").parquet(f"{root}/versions").agg(
        F.max_by("path", "version")).first()[0]
    return spark.read.parquet(newest)
