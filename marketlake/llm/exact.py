"""Exact de-duplication: a tree-merge of sorted digest runs.

Every partition sorts its digests into a run and folds equal neighbours, so a group of copies leaves a
partition as one row. Then the runs are exchanged in rounds. In round ``r`` a partition keeps, of the
digests, those whose ``r``-th digit is its own and swaps the others with the partners that differ from it
in that digit only (a binomial exchange when the radix is two). What arrives is merged in digest order and
folded again; the fold keeps the best row and its smallest identifier. After the last round every digest is
in one partition, and no partition ever saw a group of copies, only one row for each run it received.

A digest is the SHA-256 of the normalised text. Every fold verifies that rows of one digest agree in the
length and in a second, unrelated hash of that text, and stops the job if they do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import BLANKS, tasks, whole
from marketlake.session import stored

#: Partners in one round. A round more costs another exchange of the runs, a larger radix more files.
RADIX = 16
RUN = "digest binary, n_bytes long, witness long, best_chars long, best_id long, best_rows long, group_size long"


def normalised(text: Column | str) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(whole(text), BLANKS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the digest of its normalised text, and the length of the original."""
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("bare"),
                       F.length(whole(text_col)).cast("long").alias("n_chars"))
    return bare.select("doc_id", F.unhex(F.sha2("bare", 256)).alias("digest"),
                       F.octet_length("bare").cast("long").alias("n_bytes"),
                       F.xxhash64("bare").alias("witness"), "n_chars")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal neighbours of a sorted run become one row; the first of them is the best."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        rows = table.to_batches()[0]
        differs = pc.not_equal(rows["digest"].slice(1), rows["digest"].slice(0, rows.num_rows - 1))
        starts = np.concatenate(([0], np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1))
        lengths = np.diff(np.concatenate((starts, [rows.num_rows])))
        of = np.repeat(starts, lengths)
        for name in ("n_bytes", "witness"):
            values = rows[name].to_numpy(zero_copy_only=False)
            if (values != values[of]).any():
                raise ValueError("two different texts have one SHA-256 digest")
        first = rows.take(pa.array(of))
        tied = pc.and_(pc.equal(rows["best_chars"], first["best_chars"]),
                       pc.or_(pc.fill_null(pc.equal(rows["best_id"], first["best_id"]), False),
                              pc.and_(pc.is_null(rows["best_id"]), pc.is_null(first["best_id"]))))
        best_rows = np.where(tied.to_numpy(zero_copy_only=False), rows["best_rows"].to_numpy(), 0)
        folded = rows.take(pa.array(starts))
        for name, values in (("best_rows", best_rows), ("group_size", rows["group_size"].to_numpy())):
            at = folded.schema.get_field_index(name)
            folded = folded.set_column(at, folded.schema.field(at), pa.array(np.add.reduceat(values, starts), pa.int64()))
        if folded.num_rows > 1:
            yield folded.slice(0, folded.num_rows - 1)
        held = folded.slice(folded.num_rows - 1)
    if held is not None:
        yield held


def _run(df: DataFrame) -> DataFrame:
    """Each partition sorted and folded. The sort is Spark's, which merges and spills."""
    ordered = df.sortWithinPartitions("digest", F.desc("best_chars"), F.asc_nulls_last("best_id"))
    return ordered.mapInArrow(_fold, RUN)


def merge_runs(rows: DataFrame, partitions: int | None = None, radix: int = RADIX) -> DataFrame:
    """One row per distinct digest of ``rows`` (as :func:`digests` gives them).

    Gives ``digest``, ``group_size`` (rows), ``best_chars`` and ``best_id`` (most code points, then the smallest
    id, null ids last) and ``best_rows`` (rows that share both, more than one only where rows repeat).
    """
    wanted = max(2, partitions or tasks(rows.sparkSession))
    rounds = 1
    while radix**rounds < wanted:
        rounds += 1
    base = next(k for k in range(2, radix + 1) if k**rounds >= wanted)
    runs = _run(rows.select("digest", "n_bytes", "witness", F.col("n_chars").alias("best_chars"),
                            F.col("doc_id").alias("best_id"), F.lit(1).cast("long").alias("best_rows"),
                            F.lit(1).cast("long").alias("group_size")))
    home = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % F.lit(base**rounds)
    for r in range(rounds):
        def digit(place: Column, r: int = r) -> Column:
            return F.floor(place / F.lit(base**r)).cast("long") % F.lit(base)
        here = (F.spark_partition_id() % F.lit(base**rounds)).cast("long")
        to = here + (digit(home) - digit(here)) * F.lit(base**r)
        placed = runs.withColumn("to", to.cast("int"))
        runs = _run(placed.repartitionById(base**rounds, F.col("to")).drop("to"))
    return runs


def _hot(groups: DataFrame, total: int) -> int:
    """Groups at least this large are joined by broadcast; there are 1,000 of them at most."""
    return max(1_000, total // 1_000)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     partitions: int | None = None, radix: int = RADIX) -> DataFrame:
    """Class of every document under equality of the text without white space.

    One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Of equal texts the one with
    most code points stays, then the smallest id; null ids come last. A null text is empty, and empty texts equal
    each other. Rows that repeat an id and a text are one document: they count in ``group_size`` and all say the
    same. An empty table gives no row; other columns are not read.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    groups = stored(merge_runs(rows, partitions, radix), "runs")
    fields = groups.select("digest", "best_chars", "best_id", "group_size")
    large = F.col("group_size") >= _hot(groups, rows.count())
    of_large = rows.join(F.broadcast(fields.filter(large)), "digest")
    rest = rows.join(F.broadcast(fields.filter(large).select("digest")), "digest", "left_anti")
    found = of_large.unionByName(rest.join(fields.filter(~large), "digest"))
    best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_chars") == F.col("best_chars"))
    return found.select("doc_id", F.col("best_id").alias("keep_id"), "group_size", best.alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns: one row for each distinct normalised text.

    The winners are looked up by digest, length and id, so a group of copies is spread over all tasks.
    """
    groups = stored(merge_runs(digests(docs, id_col, text_col)), "runs")
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"),
                      F.unhex(F.sha2(normalised(text_col), 256)).alias("_digest"),
                      F.length(whole(text_col)).cast("long").alias("_chars"))
    match = ((F.col("_digest") == F.col("digest")) & (F.col("_chars") == F.col("best_chars"))
             & F.col("_id").eqNullSafe(F.col("best_id")))
    once = own.join(groups.filter("best_rows = 1"), match, "left_semi")
    repeated = own.join(groups.filter("best_rows > 1"), match, "left_semi").dropDuplicates(["_digest"])
    return once.unionByName(repeated).select("row.*")
