"""Named queries, each with the plain SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, which is what the SQL gives."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, IntegerType)]
    return df.withColumns({c: F.col(c).cast("bigint") for c in ints}) if ints else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: _wide(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded by the same arithmetic as the SQL; unlike ``round`` it takes no decimal detour per value."""
    c = F.col(c) if isinstance(c, str) else c
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def _digits(names: str) -> list[tuple[str, int]]:
    """``'a b:2'`` -> a to 6 decimals, b to 2."""
    return [(n, int(d or 6)) for n, _, d in (word.partition(":") for word in names.split())]


def shown(df: DataFrame, *cols: str, r: str = "") -> DataFrame:
    """Select columns, days as text, rounding those named in ``r``."""
    days = {f.name for f in df.schema if isinstance(f.dataType, DateType)}
    plain = [F.col(c).cast("string").alias(c) if c in days else F.col(c) for c in cols]
    return df.select(*plain, *[r6(c, d).alias(c) for c, d in _digits(r)])


def six(names: str) -> str:
    """The SQL counterpart of the rounded columns of :func:`shown`."""
    return ", ".join(f"floor(({c}) * 1e{d} + 0.5) / 1e{d} AS {c}" for c, d in _digits(names))
