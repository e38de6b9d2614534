"""Streaming twins of the stateful operators.

Every job equals its batch operator on the same input as long as each key's rows arrive in order; of holdings,
indicators and chat, a row older than what its key has already seen is kept in the output and marked late. Quotes and
news may come in any order: of quotes the newest stays, of news each url once. State per key is a few
numbers (or one cut text). A micro-batch, and so what a key can bring at once, is bounded by the source's
rate option.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from marketlake.operators.chat import LIMIT
from marketlake.operators.matching import matches
from marketlake.streaming import newest, positions
from marketlake.streaming.newest import COMPACT, Rule

NO_TIMEOUT = GroupStateTimeout.NoTimeout
BEGIN = pd.Timestamp("1900-01-01")


def _sorted(chunks: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All chunks of a key in one micro-batch, in order; sorting each chunk alone would not do."""
    return pd.concat(list(chunks), ignore_index=True).sort_values(by, kind="stable")


# --- holdings ---------------------------------------------------------------------------------

def stream_holdings(trades: DataFrame, root: str, checkpoint: str, opening: DataFrame | None = None, interval: str | None = None,
                    compact: int = COMPACT, **fold) -> StreamingQuery:
    """Trades into current positions and refused trades, kept below ``root``; every micro-batch is one distributed fold."""
    return positions.start(trades, root, checkpoint, opening, interval, compact, **fold)


def current_holdings(spark: SparkSession, root: str, opening: DataFrame | None = None) -> DataFrame:
    """The open positions. ``opening`` holds the positions that the stream started from: those not traded are as they were."""
    return positions.current(spark, root, opening)


def rejected_trades(spark: SparkSession, root: str) -> DataFrame:
    return positions.rejected(spark, root)


# --- indicators -------------------------------------------------------------------------------

TAIL = 50
INDICATORS = (
    "symbol string, date timestamp, close double, macd double, signal_line double, sma_20 double, "
    "sma_50 double, rsi double, bb_middle double, bb_upper double, bb_lower double, late boolean"
)
_ALPHA = {"fast": 2 / 13, "slow": 2 / 27, "signal": 2 / 10}


def _over(x: np.ndarray, n: int, fn) -> np.ndarray:
    """``fn`` of the last ``n`` values at each place; nothing before there are as many."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1:] = fn(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def _indicate(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = _sorted(chunks, ["date"])
    tail, ema, last = [], None, BEGIN
    if state.exists:
        closes, fast, slow, signal, at = state.get
        tail, ema, last = list(closes), [fast, slow, signal], pd.Timestamp(at)
    late = rows["date"] <= last
    new = rows[~late]
    done = new[["symbol", "date", "close"]].reset_index(drop=True)
    lines = []
    for x in done["close"]:
        if ema is None:
            ema = [x, x, 0.0]
        else:
            fast = ema[0] + _ALPHA["fast"] * (x - ema[0])
            slow = ema[1] + _ALPHA["slow"] * (x - ema[1])
            ema = [fast, slow, ema[2] + _ALPHA["signal"] * (fast - slow - ema[2])]
        lines.append((ema[0] - ema[1], ema[2]))
    done[["macd", "signal_line"]] = pd.DataFrame(lines, columns=["m", "s"], dtype="float64")
    close = np.array([*tail, *done["close"]], dtype="float64")
    change = np.diff(close, prepend=close[:1])
    up, down = _over(np.maximum(change, 0), 14, np.mean), _over(np.maximum(-change, 0), 14, np.mean)
    moved = np.where(up + down > 0, up + down, np.nan)  # no movement at all has no strength
    middle, dev = _over(close, 20, np.mean), _over(close, 20, lambda x, axis: x.std(axis=axis, ddof=1))
    figures = pd.DataFrame({
        "sma_20": middle, "sma_50": _over(close, 50, np.mean), "rsi": 100 * up / moved,
        "bb_middle": middle, "bb_upper": middle + 2 * dev, "bb_lower": middle - 2 * dev,
    }).iloc[len(tail):].reset_index(drop=True)
    yield pd.concat([done, figures], axis=1).assign(late=False)
    if late.any():
        yield rows.loc[late, ["symbol", "date", "close"]].reindex(
            columns=[c.split()[0] for c in INDICATORS.split(", ")]).assign(late=True)
    if len(new):
        state.update((close[-TAIL:].tolist(), *ema, done["date"].iloc[-1].to_pydatetime()))


def stream_indicators(bars: DataFrame) -> DataFrame:
    """Each bar with its indicators; state per symbol is the last 50 closes and three running means."""
    return bars.select("symbol", F.col("date").cast("timestamp").alias("date"), "close").groupBy(
        "symbol").applyInPandasWithState(
        _indicate, INDICATORS,
        "closes array<double>, fast double, slow double, signal double, at timestamp", "append", NO_TIMEOUT)


# --- quotes and news --------------------------------------------------------------------------

#: The newest quote of a symbol; of equally new ones that of the provider with the lowest priority number.
QUOTE = Rule(("symbol",), ("ts", "-priority"))


def stream_latest_quote(quotes: DataFrame, root: str, checkpoint: str, interval: str | None = None,
                        compact: int = COMPACT) -> StreamingQuery:
    """Quotes (symbol, ts, source, priority, ...) in any order into the newest one of each symbol, kept below ``root``.

    A quote goes on only if it wins, however late it is: there is no watermark that would drop the only quote of a quiet
    symbol. :func:`latest_quotes` reads the state, :func:`newest.winners` what has won so far.
    """
    return newest.start(quotes, root, checkpoint, QUOTE, interval, compact)


def latest_quotes(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The newest quote per symbol: one row for each and the few that won since the last base, not the log."""
    return newest.current(spark, root, schema, QUOTE)


def newest_quotes(quotes: DataFrame) -> DataFrame:
    """The newest quote per symbol of a table: what the stream must come to."""
    return newest.newest(quotes, QUOTE)


def stream_news_match(news: DataFrame, queries: DataFrame, url: str = "url") -> DataFrame:
    """Arriving articles with each standing query found in them, each url once for a query, however late.

    State holds the (query, url) pairs met so far, in the state store and for ever, so nobody reads the log to drop repeats.
    Which of the repeats of one micro-batch goes on is open; of several micro-batches it is the first one's. An article
    without a url equals no other: all of them go on, past the state.
    """
    def hits(rows: DataFrame) -> DataFrame:
        return matches(rows, ["headline", "summary"], queries, "query_id", "query")

    known = hits(news.filter(F.col(url).isNotNull())).dropDuplicates(["query_id", url])
    return known.unionByName(hits(news.filter(F.col(url).isNull())))


# --- chat context -----------------------------------------------------------------------------

CONTEXT = (
    "session_id string, id bigint, message string, timestamp timestamp, context string, late boolean"
)


def stream_chat_context(msgs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Each user message with its context; state per session is the latest reply, already cut."""

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(chunks, ["timestamp", "id"])
        context, last = (None, (BEGIN, -1))
        if state.exists:
            context, last = state.get[0], (pd.Timestamp(state.get[1]), state.get[2])
        out = []
        for m in rows.itertuples(index=False):
            late = (m.timestamp, m.id) <= last
            if m.is_user:
                out.append((key[0], m.id, m.message, m.timestamp, None if late else context, late))
            elif not late:
                context = m.reply
            if not late:
                last = (m.timestamp, int(m.id))
        state.update((context, last[0].to_pydatetime(), last[1]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CONTEXT.split(", ")])

    cut = F.when(F.length("message") > limit, F.concat(F.substring("message", 1, limit), F.lit("...")))
    rows = msgs.select(
        "session_id", "id", F.when(F.col("is_user"), F.col("message")).alias("message"), "is_user", "timestamp",
        F.when(~F.col("is_user"), cut).alias("reply"))
    return rows.groupBy("session_id").applyInPandasWithState(
        follow, CONTEXT, "context string, at timestamp, id bigint", "append", NO_TIMEOUT)
