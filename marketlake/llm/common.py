"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators understand it: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_place(df: DataFrame, names: list[str]) -> DataFrame:
    """Some columns, named by their places: functions over Arrow batches take no names that need quotes."""
    return df.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)))


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Some stretches of ``flat``, by number, one after the other."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def joined(parts: pa.Array, counts: list[int] | np.ndarray, known: dict[str, bytes], learn: Callable[[list[str]], list[bytes]], most: int) -> Iterator[np.ndarray]:
    """32-bit numbers of texts, each made of so many ``parts``, from the numbers of these.

    Equal parts are looked up once. ``learn`` gives the numbers, as bytes, of parts that are not ``known``; those met
    more than once are known from then on, ``most`` of them at a time, if they are not long.
    """
    told = parts.dictionary_encode()
    at, distinct = told.indices.to_numpy(zero_copy_only=False), told.dictionary.to_pylist()
    found = list(map(known.get, distinct))
    new = [i for i, x in enumerate(found) if x is None]
    for i, x in zip(new, learn([distinct[i] for i in new])):
        found[i] = x
    times = np.bincount(at, minlength=len(distinct)).tolist()
    again = [i for i in new if times[i] > 1 and len(distinct[i]) <= 64]
    if len(known) + len(again) > most:  # what these texts share with those before stays
        stay = {p: known[p] for p in distinct if p in known}
        known.clear()
        known.update(stay)
    known.update((distinct[i], found[i]) for i in again[:max(0, most - len(known))])
    sizes = np.array(list(map(len, found)), np.int64) // 4
    starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), np.int32)
    ends = np.cumsum(counts)
    for a, b in zip([0, *ends], ends):
        yield gathered(flat, starts, sizes, at[a:b])


def kept(operator: str, key: str, make):
    """What ``make`` gives, once for each worker process and key, until another operator comes to the worker.

    Worker functions travel by value, so their modules' globals are new in every task; this place is not. An operator
    that comes gives back to the system what the one before it remembered: a worker holds the memory of one of them.
    """
    import sys
    import types

    state = sys.modules.setdefault("_marketlake_worker", types.ModuleType("_marketlake_worker"))
    if getattr(state, "operator", None) != operator:
        state.operator, state.values = operator, {}
        released()
    if key not in state.values:
        state.values[key] = make()
    return state.values[key]


def freeing(work):
    """``work`` over batches; what it has freed at its end goes back to the system, as a worker waits or does something else then."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        released(collect=False)
    return run


def released(collect: bool = True) -> None:
    """Memory that a worker has freed goes back to the system, where its C library can do that."""
    import ctypes
    import gc

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
