"""Technical indicators over daily bars, all symbols at once.

Input: one row per (symbol, date) with a non-null ``close``. A rolling value is null until its frame
holds enough non-null inputs. Rows run by date, oldest first; ``descending=True`` gives payload order
of feeds that list the newest day first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketlake.operators.groups import BLOCK_ROWS, HOT_ROWS, by_group

_DECADES = 560.0  # weights within an EMA block run from 1e-280 to 1e280
_FADED = 40.0  # a weight of 1e-40 changes no double
_MAX_ROUNDS = 4  # each carry round adds two window steps to the plan

Frame = Callable[[DataFrame, list[str], list[Column], int], DataFrame]


def _run(bars: DataFrame, fn: Frame, lead_in: int, descending: bool, hot_rows: int, block_rows: int) -> DataFrame:
    date = F.col("date").desc() if descending else F.col("date")
    return by_group(bars, ["symbol"], [date], fn, lead_in, hot_rows, block_rows)


def _rolling(group: Sequence[str], order: Sequence[Column], n: int):
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(-(n - 1), 0)


def _mean(col: str, n: int, w) -> Column:
    """Mean of a full frame. The count that shows it is full is the divisor too."""
    return F.when(F.count(col).over(w) == n, F.sum(col).over(w) / n)


def _dev(col: str, n: int, w) -> Column:
    return F.when(F.count(col).over(w) == n, F.stddev_samp(col).over(w))


def _diff(col: str, group: Sequence[str], order: Sequence[Column]) -> Column:
    return F.col(col) - F.lag(col).over(Window.partitionBy(*group).orderBy(*order))


def _gain(diff: Column) -> Column:
    return F.when(diff > 0, diff).otherwise(0.0)


def _loss(diff: Column) -> Column:
    return F.when(diff < 0, -diff).otherwise(0.0)


def _rsi(gain: Column, loss: Column) -> Column:
    """100 - 100 / (1 + gain/loss): no losses give 100, no movement at all gives null."""
    return (
        F.when(loss > 0, 100.0 - 100.0 / (1.0 + gain / loss))
        .when((loss == 0) & (gain > 0), F.lit(100.0))
    )


def sma(bars: DataFrame, n: int = 20, col: str = "close", out: str | None = None, descending: bool = False,
        hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the last ``n`` rows."""
    def fn(df, group, order, longest):
        return df.withColumn(out or f"sma_{n}", _mean(col, n, _rolling(group, order, n)))
    return _run(bars, fn, n - 1, descending, hot_rows, block_rows)


def price_diff(bars: DataFrame, col: str = "close", descending: bool = False,
               hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Change from the row before; null on the first row."""
    def fn(df, group, order, longest):
        return df.withColumn("diff", _diff(col, group, order))
    return _run(bars, fn, 1, descending, hot_rows, block_rows)


def gain_loss(bars: DataFrame, col: str = "close", descending: bool = False,
              hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Gain and loss parts of the change; the first row counts as no change."""
    def fn(df, group, order, longest):
        return (df.withColumn("diff", _diff(col, group, order))
                .withColumn("gain", _gain(F.col("diff"))).withColumn("loss", _loss(F.col("diff"))))
    return _run(bars, fn, 1, descending, hot_rows, block_rows)


def _with_rsi(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, col: str) -> DataFrame:
    w = _rolling(group, order, n)
    return (
        df.withColumn("diff", _diff(col, group, order))
        .withColumn("gain", _gain(F.col("diff"))).withColumn("loss", _loss(F.col("diff")))
        .withColumn("gain_mean", _mean("gain", n, w))
        .withColumn("loss_mean", _mean("loss", n, w))
        .withColumn("rsi", _rsi(F.col("gain_mean"), F.col("loss_mean")))
    )


def gain_loss_mean(bars: DataFrame, n: int = 14, col: str = "close", descending: bool = False,
                   hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Simple means of gain and loss over the last ``n`` rows."""
    def fn(df, group, order, longest):
        return _with_rsi(df, group, order, n, col).drop("rsi")
    return _run(bars, fn, n, descending, hot_rows, block_rows)


def rsi(bars: DataFrame, n: int = 14, col: str = "close", descending: bool = False,
        hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    def fn(df, group, order, longest):
        return _with_rsi(df, group, order, n, col).withColumnRenamed("rsi", f"rsi_{n}").drop(
            "diff", "gain", "loss", "gain_mean", "loss_mean")
    return _run(bars, fn, n, descending, hot_rows, block_rows)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, col: str = "close", descending: bool = False,
              hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rolling mean and the bands ``k`` sample standard deviations around it."""
    def fn(df, group, order, longest):
        return _with_bands(df, group, order, n, k, col)
    return _run(bars, fn, n - 1, descending, hot_rows, block_rows)


def _with_bands(df, group, order, n, k, col):
    w = _rolling(group, order, n)
    return (
        df.withColumn("bb_middle", _mean(col, n, w))
        .withColumn("_dev", _dev(col, n, w))
        .withColumn("bb_upper", F.col("bb_middle") + k * F.col("_dev"))
        .withColumn("bb_lower", F.col("bb_middle") - k * F.col("_dev"))
        .drop("_dev")
    )


def _decay(span: int) -> float:
    """Decades by which the weight of a row falls with every later row."""
    return -math.log10(1.0 - 2.0 / (span + 1))


def ema_lead_in(*spans: int) -> int:
    """Rows after which an EMA (of an EMA ...) has forgotten its start."""
    return sum(math.ceil(_FADED / _decay(s)) for s in spans)


class _Scan(NamedTuple):
    """How an EMA runs over its rows: in blocks of ``size``, or in one when no group is longer."""

    size: int
    order: list[Column]
    inside: WindowSpec
    before: WindowSpec | None


def _numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], spans: Sequence[int],
              longest: int, block: int | None) -> tuple[DataFrame, _Scan]:
    """Add the row number ``_i`` and the place in the block ``_t``; ``_b`` is the block if there are several."""
    size = block or int(_DECADES / _decay(min(spans)))
    df = df.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    if longest <= size:
        whole = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn("_t", F.col("_i")), _Scan(
            size, list(order), whole.rowsBetween(Window.unboundedPreceding, 0), None)
    df = df.withColumns({"_b": F.floor(F.col("_i") / size).cast("int"), "_t": F.col("_i") % size})
    again = [F.col("_b"), F.col("_i")]
    return df, _Scan(
        size, again,
        Window.partitionBy(*group, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0),
        Window.partitionBy(*group).orderBy(*again).rowsBetween(Window.unboundedPreceding, -1))


def _ema(df: DataFrame, scan: _Scan, wanted: Sequence[tuple[str, str, int]],
         others: dict[str, Column] | None = None) -> DataFrame:
    """Add an EMA for each (output, input, span) in ``wanted`` on a frame from :func:`_numbered`.

    Within a block the EMA is a running sum of inputs scaled by ``(1-a)^-t``. A whole block later a weight
    has faded, so the value carried into a block is made of the ends of as many blocks before it as still
    count: one, unless the block is short for the span. ``others`` are window columns over the same rows,
    added in the same step.
    """
    half = scan.size // 2  # centres the powers, so that a block can be twice as long
    first, at_end = F.col("_i") == 0, F.col("_t") == scan.size - 1
    beta = {out: 1.0 - 2.0 / (span + 1) for out, _, span in wanted}
    df = df.withColumns({f"_p_{out}": F.pow(F.lit(beta[out]), F.col("_t") - half) for out in beta})
    df = df.withColumns({
        f"_s_{out}": F.when(first, F.col(col)).otherwise((1.0 - beta[out]) * F.col(col)) / F.col(f"_p_{out}")
        for out, col, _ in wanted})
    df = df.withColumns({
        **{f"_l_{out}": F.col(f"_p_{out}") * F.sum(f"_s_{out}").over(scan.inside) for out in beta},
        **(others or {})})
    if scan.before is None:
        return df.withColumns({out: F.col(f"_l_{out}") for out in beta}).drop(
            *[f"_{p}_{out}" for out in beta for p in "psl"])
    rounds = max(math.ceil(_FADED / (_decay(span) * scan.size)) for _, _, span in wanted)
    if rounds > _MAX_ROUNDS:
        raise ValueError(f"a block of {scan.size} rows is too short for these spans")
    df = df.withColumns({f"_y_{out}": F.col(f"_l_{out}") for out in beta})
    for _ in range(rounds):
        df = df.withColumns({
            f"_c_{out}": F.last(F.when(at_end, F.col(f"_y_{out}")), ignorenulls=True).over(scan.before)
            for out in beta
        }).withColumns({
            f"_y_{out}": F.col(f"_l_{out}") + F.col(f"_p_{out}") * F.lit(beta[out] ** (half + 1))
            * F.coalesce(F.col(f"_c_{out}"), F.lit(0.0)) for out in beta
        })
    return df.withColumns({out: F.col(f"_y_{out}") for out in beta}).drop(
        *[f"_{p}_{out}" for out in beta for p in "pslyc"])


def ema(bars: DataFrame, col: str = "close", spans: Sequence[int] = (12, 26), block: int | None = None,
        descending: bool = False, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exponential means ``y = (1-a) y' + a x`` with ``a = 2 / (span + 1)``, started at the first value."""
    def fn(df, group, order, longest):
        keep = df.columns
        for span_group in _alike(spans):
            df, scan = _numbered(df, group, order, span_group, longest, block)
            df = _ema(df, scan, [(f"ema_{s}", col, s) for s in span_group])
        return df.select(*keep, *[f"ema_{s}" for s in spans])
    return _run(bars, fn, max(ema_lead_in(s) for s in spans), descending, hot_rows, block_rows)


def _alike(spans: Sequence[int]) -> list[list[int]]:
    """Spans that can share one block size: the slowest still fades within a block."""
    groups: list[list[int]] = []
    for span in sorted(set(spans)):
        if groups and _decay(span) * int(_DECADES / _decay(groups[-1][0])) >= _FADED:
            groups[-1].append(span)
        else:
            groups.append([span])
    return groups


def _with_macd(df, scan, fast, slow, span, col, others=None):
    df = _ema(df, scan, [("_fast", col, fast), ("_slow", col, slow)], others)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return _ema(df, scan, [("signal_line", "macd", span)]) if span else df


def _apart(df, group, order, longest, block, wanted):
    """EMAs (output, input, span) of any spans: those that fade alike run over blocks of one size."""
    for spans in _alike([span for *_, span in wanted]):
        df, scan = _numbered(df, group, order, spans, longest, block)
        df = _ema(df, scan, [w for w in wanted if w[2] in spans])
    return df


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, col: str = "close", block: int | None = None,
         descending: bool = False, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    def fn(df, group, order, longest):
        df = _apart(df, group, order, longest, block, [("_fast", col, fast), ("_slow", col, slow)])
        return df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow", "_i", "_b", "_t")
    return _run(bars, fn, ema_lead_in(max(fast, slow)), descending, hot_rows, block_rows)


def macd_signal(bars: DataFrame, fast: int = 12, slow: int = 26, span: int = 9, col: str = "close",
                block: int | None = None, descending: bool = False,
                hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """MACD and its signal line, the EMA of the MACD."""
    def fn(df, group, order, longest):
        df = _apart(df, group, order, longest, block, [("_fast", col, fast), ("_slow", col, slow)])
        df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
        return _apart(df, group, order, longest, block, [("signal_line", "macd", span)]).drop("_fast", "_slow", "_i", "_b", "_t")
    return _run(bars, fn, ema_lead_in(max(fast, slow), span), descending, hot_rows, block_rows)


def technical_indicators(bars: DataFrame, descending: bool = False, block: int | None = None,
                         hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All indicators of a symbol: one exchange and one sort, a second sort only for very long series."""
    def fn(df, group, order, longest):
        w20, w50 = _rolling(group, order, 20), _rolling(group, order, 50)
        df = df.withColumns({  # one window step, with the row numbers
            "sma_20": _mean("close", 20, w20),
            "sma_50": _mean("close", 50, w50),
            "_dev": _dev("close", 20, w20),
            "_diff": _diff("close", group, order),
        })
        df, scan = _numbered(df, group, order, [12, 26, 9], longest, block)
        df = df.withColumns({"_gain": _gain(F.col("_diff")), "_loss": _loss(F.col("_diff"))})
        w14 = _rolling(group, scan.order, 14)
        means = {  # one window step, with the running sums of the first two EMAs
            "_gm": F.sum("_gain").over(w14) / 14,
            "_lm": F.sum("_loss").over(w14) / 14,
        }
        return _with_macd(df, scan, 12, 26, 9, "close", means).withColumns({
            "rsi": F.when(F.col("_i") >= 13, _rsi(F.col("_gm"), F.col("_lm"))),  # gain and loss are never null
            "bb_middle": F.col("sma_20"),
            "bb_upper": F.col("sma_20") + 2 * F.col("_dev"),
            "bb_lower": F.col("sma_20") - 2 * F.col("_dev"),
        }).drop("_i", "_b", "_t", "_dev", "_gm", "_lm", "_diff", "_gain", "_loss")
    return _run(bars, fn, ema_lead_in(26, 9) + 50, descending, hot_rows, block_rows)
