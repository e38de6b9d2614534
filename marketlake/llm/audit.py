"""How filters interact: what each removes in every order, what it would have removed, and what is lost by it.

A document has a bit for each filter that it fails. Everything the audit asks for follows from how many documents have
which bits, so documents are counted by part and bits first, and orders are tried on these counts.
"""

from __future__ import annotations

import json
import re
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm import tries

#: The filters, in the order of their bits; the last is a text that a smaller id has already.
FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")

_CAPITALS = re.compile("[A-Z]")


def failed(text: str) -> int:
    """The bits of the filters A to D that a text fails. Words are what stands between ASCII white space.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 2 % capitals A-Z. D: any of ``#$%&*|``.
    """
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    signs = len(data) - len(data.translate(None, b"#$%&*|"))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * capitals > 2 * len(text)) << 2 | (signs > 0) << 3)


def _steps(letters: str) -> Column:
    """Every order of the filters with its steps: the step's bit, and the bits of the filters before it."""
    rows = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append({"filter_order": "".join(letters[j] for j in order), "step": step, "bit": 1 << i, "before": before})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def interactions(counted: DataFrame, letters: str = FILTERS) -> DataFrame:
    """The audit of counts by ``part`` and ``mask``: ``n`` documents, of them ``good`` and ``toxic`` ones.

    A row for each part, order of the filters and step, zeros included: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (fail its filter, were removed before), ``unique_fails`` (fail its filter only), ``good_lost`` and
    ``toxic_lost`` (of the removed ones), ``shapley`` (what its filter removes, summed over all orders).
    """
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = cells.select("part", "cells", F.explode(_steps(letters)).alias("s"))

    def total(test, value=lambda c: c["n"]) -> Column:
        bit, before = F.col("s.bit"), F.col("s.before")
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(
            test(c["mask"], bit, before), value(c)).otherwise(F.lit(0).cast("long")))

    def here(mask: Column, bit: Column, before: Column) -> Column:
        return (mask.bitwiseAND(bit) != 0) & (mask.bitwiseAND(before) == 0)

    orders = 1
    for i in range(2, len(letters) + 1):
        orders *= i
    first = F.lit(orders)  # of a document that fails k filters, each removes it in one of k orders
    return rows.select(
        "part", "s.filter_order", "s.step",
        total(lambda m, bit, before: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m, bit, before: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m, bit, before: m == bit).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda m, bit, before: m.bitwiseAND(bit) != 0,
              lambda c: c["n"] * (first / F.bit_count(c["mask"])).cast("long")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """The filters A to E on whole texts, in all 120 orders, by part.

    A document is good or toxic if any of its rows in ``labels`` (doc_id, quality, toxic) says 1; null labels and rows
    without an id say nothing. A null text is empty, a null part the empty string; a row without an id is a document
    that repeats no other. Rows that repeat an id are documents of their own, and none of them repeats the other, as
    its id is not smaller. Very long texts are compared whole. An empty table gives no row. Other columns are not read.
    """
    rows = tries.marked(docs, failed, REPEATED, id_col, part_col, text_col)
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # rows without an id find no label; they are dealt by chance instead of to one task
    salt = F.when(F.col("doc_id").isNull(), F.spark_partition_id() * 1_009 + F.col("mask") + 1).otherwise(0)
    joined = rows.withColumn("salt", salt).join(said.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left")
    yes = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return interactions(joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *yes))
