"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

A round sorts what is left of the documents and the gaps of all sequences together by size, largest first, over
ranges of equal weight. Each task sweeps its range once: a piece takes the smallest gap at or above it, and the
rest of that gap is a gap again, for smaller pieces of the same range. What finds no successor in its own range
competes for the gaps that larger ranges have left over: there the rank decides, the largest piece of a range
first, the nearest range first, the smallest gap first. Then gaps are updated and the next round begins.

New sequences are opened at the start of a round, as many as no packing can do without: for every size, what the
pieces at or above it hold beyond all gaps at or above it. Sizes are whole numbers up to the capacity, so this takes one
number for each size. Once pieces and gaps fit into one range, its sweep opens sequences itself and the packing is done.
"""

from __future__ import annotations

import heapq
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import joined, kept, whole
from marketlake.session import stored

#: Chunks of text whose ids a worker remembers; it bounds memory, not results.
REMEMBERED = 300_000
#: Rows of a range, and ranges at most: few rows to a range cost rounds, many cost time in one task.
RANGE_ROWS, RANGES = 50_000, 10_000
PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


class _Chunks:
    """Ids by chunk of text between blanks; the tokenizer drops blanks, so chunks do not touch.

    A letter or digit and the stop after it are different pieces to it, so they are chunks of their own.
    """

    stop = "([A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([.,;:!?])"

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self._known: dict[str, bytes] = {}  # ids as little-endian bytes

    def _learn(self, new: list[str], row: int = 100) -> list[bytes]:
        """Some chunks as one text; each id belongs to the chunk in which its place is."""
        out = []
        for at in range(0, len(new), 100 * row):
            rows = [new[i:i + row] for i in range(at, min(at + 100 * row, len(new)), row)]
            for chunks, found in zip(rows, self.tokenizer.encode_batch([" ".join(r) for r in rows], add_special_tokens=False)):
                starts = np.cumsum([len(c) + 1 for c in chunks])
                of = np.searchsorted(starts, np.array([a for a, _ in found.offsets], np.int64), "right")
                ends = (4 * np.searchsorted(of, np.arange(len(chunks) + 1))).tolist()
                ids = np.array(found.ids, "<u4").tobytes()
                out += [ids[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of many texts, which share the work on new chunks."""
        parted = pc.replace_substring_regex(texts.cast(pa.large_string()), self.stop, r"\1 \2")
        chunks = pc.ascii_split_whitespace(parted)
        counts = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        return joined(chunks.flatten(), counts, self._known, self._learn, REMEMBERED)

    def ids(self, text: str) -> list[int]:
        return next(self.ids_of(pa.array([text]))).tolist()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2_048, end: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: the tokenizer's ids without special tokens, then ``end``.

    Gives ``uid, doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``. Only longer documents are cut,
    into full pieces and a last one. A null text is empty: one piece of ``end``. The tokenizer must drop white space
    and treat what is between alone, as word BPE does. ``uid`` tells repeated ids apart; store the result before use.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # under 2 MB whatever the data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = kept("packing", f"chunks {tokenizer_path}", lambda: _Chunks(shipped.value))
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), chunks.ids_of(batch.column(1))):
                ids = found.astype("<u4").tobytes() + end.to_bytes(4, "little")
                for i, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at:4 * (at + capacity)]
                    own = np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None
                    rows.append((uid, doc_id, i, at, len(part) // 4, zlib.crc32(part), own))
                    uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = zip(*rows) if rows else ((),) * 7
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 7 if with_ids else 6
            yield pa.RecordBatch.from_arrays(arrays[:keep], names=names[:keep])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(work, PIECE + (", ids array<long>" if with_ids else ""))


SWEPT = "kind string, part int, rank long, uid long, size long, seq long, gap long"


def _sweep(batches: Iterator[pa.RecordBatch], opened: Iterator[int] = iter(()), capacity: int = 0) -> Iterator[pa.RecordBatch]:
    """One range, largest first, gaps before pieces of their size. A piece that fits nowhere takes the next sequence of ``opened``.

    Rows of kind ``placed`` (a piece and its sequence with the gap it found), ``piece`` (without a successor here, ranked
    by size) and ``gap`` (left over; ranked, smallest first, if it still reaches the range, so that it fits every piece
    of the ranges after it).
    """
    here = TaskContext.get().partitionId()
    fits: list[tuple[int, int]] = []  # gaps at or above the present size, smallest first
    later: list[tuple[int, int]] = []  # smaller ones, largest first
    unmatched, lowest = 0, 0

    def rows(found):
        columns = zip(*found) if found else ((),) * 7
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=["kind", "part", "rank", "uid", "size", "seq", "gap"])

    for batch in batches:
        found = []
        for size, of_piece, key in zip(*(batch.column(c).to_pylist() for c in ("size", "of_piece", "key"))):
            lowest = size
            if not of_piece:
                heapq.heappush(fits, (size, key))
                continue
            while later and -later[0][0] >= size:
                gap, seq = heapq.heappop(later)
                heapq.heappush(fits, (-gap, seq))
            gap, seq = heapq.heappop(fits) if fits else (capacity, next(opened, None))
            if seq is not None:
                found.append(("placed", here, None, key, size, seq, gap))
                if gap - size >= size:
                    heapq.heappush(fits, (gap - size, seq))
                else:
                    heapq.heappush(later, (size - gap, seq))
            else:
                found.append(("piece", here, unmatched, key, size, None, None))
                unmatched += 1
        yield rows(found)
    left = sorted(fits + [(-gap, seq) for gap, seq in later])
    reach = [x for x in left if x[0] >= lowest]
    ranks = dict(zip(reach, range(len(reach))))
    for at in range(0, len(left), 10_000):
        yield rows([("gap", here, ranks.get(x), None, None, x[1], x[0]) for x in left[at:at + 10_000] if x[0]])


def _resolved(counts: list) -> list[tuple[int, int, int, int, int]]:
    """Runs of ranks: pieces ``first..last`` of a range take the gaps of a range before it from a rank on."""
    free: list[list[int]] = []  # range, next rank, end; the nearest last
    runs = []
    for part, n_pieces, n_gaps in sorted(counts):
        done = 0
        while done < n_pieces and free:
            nearest = free[-1]
            n = min(n_pieces - done, nearest[2] - nearest[1])
            runs.append((part, done, done + n, nearest[0], nearest[1]))
            done += n
            nearest[1] += n
            if nearest[1] == nearest[2]:
                free.pop()
        if n_gaps:
            free.append([part, 0, n_gaps])
    return runs


def _opened(sizes: list, capacity: int) -> int:
    """New sequences that no packing of these pieces can do without: a row for each size, pieces and gaps."""
    short, most = 0, 0
    for size, n_pieces, n_gaps in sorted(sizes, reverse=True):
        short += size * (n_pieces - n_gaps)
        most = max(most, short)
    return -(-most // capacity)


def _places(found: DataFrame, capacity: int) -> DataFrame:
    return found.select("uid", F.col("seq").alias("sequence_id"), (capacity - F.col("gap")).alias("offset"))


def pack(lengths: DataFrame, capacity: int = 2_048) -> DataFrame:
    """``uid, sequence_id, offset`` for every row of ``lengths(uid, length)``, lengths from 1 to ``capacity``.

    Pieces of a sequence lie side by side from offset 0. A table without rows gives none.
    """
    spark = lengths.sparkSession
    left = lengths.select("uid", F.col("length").cast("long").alias("size"))
    gaps = spark.createDataFrame([], "seq long, gap long")
    placed, opened = [], 0
    while True:
        both = (left.select("size", F.lit(True).alias("of_piece"), F.col("uid").alias("key"))
                .unionByName(gaps.select(F.col("gap").alias("size"), F.lit(False).alias("of_piece"), F.col("seq").alias("key"))))
        # At most one row for each size up to the capacity.
        sizes = [tuple(r) for r in both.groupBy("size").agg(F.count_if("of_piece"), F.count_if(~F.col("of_piece"))).collect()]
        least = min((size for size, p, _ in sizes if p), default=None)
        if least is None:
            break
        both = both.filter(F.col("of_piece") | (F.col("size") >= least))
        order = [F.desc("size"), F.asc("of_piece"), F.asc("key")]
        rows = sum(p + g for size, p, g in sizes if size >= least)
        if rows <= RANGE_ROWS:
            first = opened
            swept = both.coalesce(1).sortWithinPartitions(*order).mapInArrow(lambda batches: _sweep(batches, itertools.count(first), capacity), SWEPT)
            placed.append(_places(stored(swept.filter("kind = 'placed'"), "swept"), capacity))
            break
        new = _opened(sizes, capacity)
        n = min(RANGES, max(2, -(-(rows + new) // RANGE_ROWS)))
        both = both.unionByName(spark.range(opened, opened + new).select(
            F.lit(capacity).cast("long").alias("size"), F.lit(False).alias("of_piece"), F.col("id").alias("key")))
        opened += new
        swept = stored(both.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_sweep, SWEPT), "swept")
        counts = swept.filter("kind <> 'placed'").groupBy("part").agg(
            F.count_if(F.col("kind") == "piece"), F.count_if((F.col("kind") == "gap") & F.col("rank").isNotNull())).collect()
        runs = spark.createDataFrame(_resolved([tuple(r) for r in counts]), "of_part int, first long, stop long, of int, at long")
        waiting, free = swept.filter("kind = 'piece'"), swept.filter("kind = 'gap'")
        inside = (F.col("part") == F.col("of_part")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
        ranked = waiting.join(F.broadcast(runs), inside, "left")
        ranked = ranked.select("uid", "size", "of", (F.col("at") + F.col("rank") - F.col("first")).alias("at"))
        won = free.filter("rank is not null").select(F.col("part").alias("of"), F.col("rank").alias("at"), "seq", "gap")
        # Pieces with the gap they take, pieces without one, and gaps that nothing takes.
        met = ranked.filter("of is not null").join(won, ["of", "at"], "full").select("uid", "size", "seq", "gap")
        none = F.lit(None).cast("long")
        settled = stored(met.unionByName(ranked.filter("of is null").select("uid", "size", none.alias("seq"), none.alias("gap")))
                         .unionByName(free.filter("rank is null").select(none.alias("uid"), none.alias("size"), "seq", "gap")), "settled")
        taken = settled.filter("uid is not null and seq is not null")
        placed += [_places(swept.filter("kind = 'placed'"), capacity), _places(taken, capacity)]
        left = settled.filter("seq is null").select("uid", "size")
        gaps = settled.filter("seq is not null").select("seq", (F.col("gap") - F.coalesce("size", F.lit(0))).alias("gap")).filter("gap > 0")
    out = spark.createDataFrame([], "uid long, sequence_id long, offset long")
    for found in placed:
        out = out.unionByName(found)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2_048, end: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: the columns of :func:`pieces` but the uid, ``sequence_id, offset``."""
    cut = stored(pieces(docs, tokenizer_path, capacity, end, id_col, text_col), "pieces")
    return cut.join(pack(cut, capacity), "uid").drop("uid")
