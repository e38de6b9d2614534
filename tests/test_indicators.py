import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake import fixtures as fx
from marketlake.operators import indicators as ind

COLS = ["sma_20", "sma_50", "rsi", "macd", "signal_line", "bb_middle", "bb_upper", "bb_lower"]


def by_pandas(df: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for _, d in df.sort_values(["symbol", "date"]).groupby("symbol", sort=False):
        c, d = d["close"], d.copy()
        d["sma_20"], d["sma_50"] = c.rolling(20).mean(), c.rolling(50).mean()
        step = c.diff().fillna(0.0)
        ups, travel = step.clip(lower=0).rolling(14).sum(), step.abs().rolling(14).sum()
        d["rsi"] = 100 * ups / travel.where(travel > 1e-9)
        d["macd"] = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        d["signal_line"] = d["macd"].ewm(span=9, adjust=False).mean()
        dev = c.rolling(20).std()
        d["bb_middle"], d["bb_upper"], d["bb_lower"] = d["sma_20"], d["sma_20"] + 2 * dev, d["sma_20"] - 2 * dev
        parts.append(d)
    return pd.concat(parts).reset_index(drop=True)


def same(got: pd.DataFrame, want: pd.DataFrame, cols=COLS):
    got = got.sort_values(["symbol", "date"]).reset_index(drop=True)
    want = want.sort_values(["symbol", "date"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in cols:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-7, err_msg=c)


def walk(spark, sizes: dict[str, int], seed=1):
    """Random walks of given lengths, rows shuffled."""
    rng, rows = np.random.default_rng(seed), []
    for symbol, n in sizes.items():
        price = 100 + np.cumsum(rng.normal(size=n))
        days = pd.date_range("2000-01-01", periods=n).date
        rows += list(zip([symbol] * n, days, price.round(2)))
    rng.shuffle(rows)
    return spark.createDataFrame([(s, d, float(p)) for s, d, p in rows], "symbol string, date date, close double")


def test_matches_pandas(spark, sf):
    bars = fx.bars_lineitem(spark, sf)
    got = ind.technical_indicators(bars).toPandas()
    same(got, by_pandas(got[["symbol", "date", "close"]]))


def test_short_series_have_nulls_until_full(spark):
    sizes = {f"n{n}": n for n in (1, 13, 14, 19, 20, 49, 50)}
    got = ind.technical_indicators(walk(spark, sizes)).toPandas()
    same(got, by_pandas(got[["symbol", "date", "close"]]))
    filled = got.groupby("symbol")[["sma_20", "sma_50", "rsi", "macd"]].count()
    assert filled.loc["n13", "rsi"] == 0 and filled.loc["n14", "rsi"] == 1
    assert filled.loc["n19", "sma_20"] == 0 and filled.loc["n20", "sma_20"] == 1
    assert filled.loc["n49", "sma_50"] == 0 and filled.loc["n50", "sma_50"] == 1
    assert filled.loc["n1", "macd"] == 1


def test_constant_and_rising(spark):
    days = pd.date_range("2000-01-01", periods=30).date
    rows = [("flat", d, 5.0) for d in days] + [("up", d, float(i)) for i, d in enumerate(days)]
    got = ind.rsi(spark.createDataFrame(rows, "symbol string, date date, close double")).toPandas()
    got = got.sort_values(["symbol", "date"])
    assert got[got.symbol == "flat"]["rsi_14"].isna().all()
    up = got[got.symbol == "up"]["rsi_14"].tolist()
    assert np.isnan(up[:13]).all() and up[13:] == [100.0] * 17


@pytest.mark.parametrize("name", ["sma", "price_diff", "gain_loss", "gain_loss_mean", "rsi", "bollinger", "ema",
                                  "macd", "macd_signal", "technical_indicators"])
def test_hot_symbol_gives_the_same(spark, name):
    fn = getattr(ind, name)
    bars = walk(spark, {"hot": 9_000, "calm": 300, "warm": 4_000})
    whole = fn(bars).toPandas()
    cut = fn(bars, hot_rows=1_000, block_rows=1_000)
    assert sorted(cut.columns) == sorted(whole.columns)
    same(cut.toPandas(), whole, [c for c in whole.columns if c not in ("symbol", "date")])


def test_long_series_matches_pandas(spark):
    bars = walk(spark, {"a": 9_000})
    got = ind.technical_indicators(bars).toPandas()
    same(got, by_pandas(got[["symbol", "date", "close"]]))


@pytest.mark.parametrize("block", [400, 700, 2_000])
def test_ema_block_size_is_free(spark, block):
    bars = walk(spark, {"a": 5_000, "b": 10})
    same(ind.ema(bars, block=block).toPandas(), ind.ema(bars).toPandas(), ["ema_12", "ema_26"])


def test_ema_of_far_apart_spans(spark):
    bars = walk(spark, {"a": 3_000})
    got = ind.ema(bars, spans=[2, 400, 9]).toPandas().sort_values("date")
    for span in (2, 9, 400):
        want = got["close"].ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(got[f"ema_{span}"], want, rtol=1e-10)


def test_too_short_block_is_refused(spark):
    with pytest.raises(ValueError):
        ind.ema(walk(spark, {"a": 50}), block=7)


def test_descending_order(spark):
    bars = walk(spark, {"a": 60})
    got = ind.sma(bars, 20, descending=True).toPandas().sort_values("date")
    want = got["close"][::-1].rolling(20).mean()[::-1]
    np.testing.assert_allclose(got["sma_20"], want)


def test_rows_in_any_partitioning(spark):
    bars = walk(spark, {"a": 200, "b": 90})
    one = ind.technical_indicators(bars.coalesce(1)).toPandas()
    same(ind.technical_indicators(bars.repartition(7, F.rand(3))).toPandas(), one)


def test_all_indicators_newest_first(spark):
    got = ind.technical_indicators(walk(spark, {"a": 90}), descending=True).toPandas()
    back = got[["symbol", "date", "close"]].sort_values("date", ascending=False).reset_index(drop=True)
    want = by_pandas(back.assign(date=back.index)).assign(date=back["date"])
    same(got, want)


@pytest.mark.parametrize("n", [1_000, 6_500])
def test_macd_of_any_spans_and_length(spark, n):
    bars = walk(spark, {"A": n, "B": 40})
    got = ind.macd_signal(bars, 2, 400, 3).toPandas()
    want = []
    for _, d in bars.toPandas().sort_values(["symbol", "date"]).groupby("symbol", sort=False):
        line = d["close"].ewm(span=2, adjust=False).mean() - d["close"].ewm(span=400, adjust=False).mean()
        want.append(d.assign(macd=line, signal_line=line.ewm(span=3, adjust=False).mean()))
    same(got, pd.concat(want), ["macd", "signal_line"])
    same(ind.macd(bars, 2, 400).toPandas(), pd.concat(want), ["macd"])
