"""Radix text tries: which documents repeat the text of one with a smaller id.

Texts are dealt to ranges by adaptive prefixes: as short as they can be where few texts begin alike, as long as they
must be where many do. Every partition first inserts its own texts into a compressed trie, whose terminals hold the
smallest id, so a group of copies leaves a partition as one text. What is left meets in its range, is inserted into the
range's trie, and the traversal tells which rows held their text first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import tasks, whole

#: Bytes of texts that a trie holds before it is emptied; it bounds memory, not results.
HELD = 32_000_000
#: Texts looked at for each range to place the borders of ranges, and bytes of each. Borders decide only where a text is
#: dealt to. Texts that are alike in so many bytes are told apart by a checksum if they are too many for one range.
LOOKED, PREFIX = 32, 256


class Node:
    """The bytes of the edge above, the nodes below by their first byte, and the terminal's smallest id and its rows."""

    __slots__ = ("label", "below", "least", "rows", "weight")

    def __init__(self, label: bytes):
        self.label, self.below, self.least, self.rows, self.weight = label, {}, None, None, 0


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of ``a`` stand in ``b`` from ``at`` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed trie of whole texts: an edge is as long as nothing branches or ends on it."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes) -> Node:
        """The terminal of a text, made if there is none."""
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = Node(key[at:])
                self.held += len(key) - at + 400
                return child
            if not key.startswith(child.label, at):
                same = _common(child.label, key, at)
                upper = node.below[key[at]] = Node(child.label[:same])
                upper.below[child.label[same]] = child
                child.label = child.label[same:]
                self.held += 400
                child = upper
            at += len(child.label)
            node = child
        return node

    def add(self, key: bytes, doc_id: int, row: tuple, n: int) -> dict | None:
        """One document; gives the rows that now have a smaller id beside them, with their id as the key."""
        node = self.insert(key)
        if node.least is None or doc_id < node.least:
            beaten = None if node.least is None else {node.least: node.rows}
            node.least, node.rows = doc_id, {row: n}
            return beaten
        if doc_id == node.least:
            node.rows[row] = node.rows.get(row, 0) + n
            return None
        return {doc_id: {row: n}}

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """All texts with their terminals."""
        todo = [(self.root, b"")]
        while todo:
            node, key = todo.pop()
            if node.least is not None:
                yield key, node
            todo.extend((child, key + child.label) for child in node.below.values())

    def ranges(self, share: float) -> tuple[list[bytes], dict[bytes, int]]:
        """Borders that cut the weights of the texts into ranges of about ``share``, and ways to split what no border can.

        A prefix is made longer only where the texts below it weigh more than half a share.
        """
        def weigh(node: Node) -> None:
            order, todo = [], [node]
            while todo:
                order.append(todo.pop())
                todo.extend(order[-1].below.values())
            for one in reversed(order):
                one.least = one.weight + sum(child.least for child in one.below.values())  # of all below

        weigh(self.root)
        borders, split, run, todo = [], {}, 0.0, [(self.root, b"")]
        while todo:
            node, key = todo.pop()
            heavy = node.least > share / 2
            own = node.weight if heavy and node.below else node.least
            if run and run + own > share:
                borders.append(key)
                run = 0.0
            run += own
            if heavy and node.below:
                todo.extend((node.below[b], key + node.below[b].label) for b in sorted(node.below, reverse=True))
            elif own > 2 * share:
                split[key[:PREFIX]] = int(own / share) + 1
        return borders, split


def _borders(texts: DataFrame, parts: int) -> tuple[list[bytes], dict[bytes, int]]:
    """Where ranges begin, from about ``LOOKED`` distinct texts for each, picked by their hash."""
    every = max(1, texts.count() // (LOOKED * parts))
    picked = texts.select(F.xxhash64("text").alias("h"), F.substring("text", 1, PREFIX).alias("text"), F.octet_length("text").alias("n")).filter(
        F.pmod("h", F.lit(every)) == 0).groupBy("h").agg(F.min_by("text", "n").alias("text"), F.min("n").alias("n")).collect()
    trie = Trie()
    for row in picked:
        trie.insert(bytes(row["text"])).weight += row["n"] + 64
    return trie.ranges(max(1.0, sum(row["n"] + 64 for row in picked) / parts))


def marked(docs: DataFrame, mask: Callable[[str], int], repeated: int, id_col: str = "doc_id", part_col: str = "source",
           text_col: str = "text") -> DataFrame:
    """The flags of every document, and ``repeated`` where a smaller id has the same text.

    Gives ``doc_id, part, mask, n``: a row for each document, or for equal rows one row and how many (``n``) they are.
    ``mask`` gives the other flags of a text; a null text is empty, a null part the empty string. Whole texts are
    compared. A row without an id neither repeats a text nor makes another row repeat it. An empty table gives no row.
    """
    spark = docs.sparkSession
    parts = tasks(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(part_col).cast("string").alias("part"), whole(text_col).alias("text"))
    borders, split = _borders(rows.select(F.col("text").cast("binary").alias("text")), parts)
    kinds = [("place", pa.int32()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())]
    schema = "place int, text binary, doc_id long, part string, mask int, n long"

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[name for name, _ in kinds])

    def place(key: bytes) -> int:
        at = bisect_right(borders, key)
        ways = split.get(key[:PREFIX], 1) if split else 1
        return (at + zlib.crc32(key) % ways) % parts

    def beaten(found: dict | None, at: int) -> list[tuple]:
        return [(at, None, i, part, m | repeated, n) for i, own in (found or {}).items() for (part, m), n in own.items()]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that are settled in their own partition, without text; of the others one row for each text."""
        def emptied(trie: Trie) -> Iterator[pa.RecordBatch]:
            found, n = [], 0
            for key, node in trie.terminals():
                at = place(key)
                found.extend((at, key, node.least, part, m, count) for (part, m), count in node.rows.items())
                n += len(key) * len(node.rows)
                if n > 4_000_000:
                    yield batch_of(found)
                    found, n = [], 0
            yield batch_of(found)

        trie, done = Trie(), []
        for batch in batches:
            for doc_id, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                m = mask(text)
                if doc_id is None:
                    done.append((len(done) % parts, None, None, part, m, 1))
                else:
                    done.extend(beaten(trie.add(text.encode(), doc_id, (part, m), 1), doc_id % parts))
                if trie.held > HELD:
                    yield from emptied(trie)
                    trie = Trie()
            yield batch_of(done)
            done = []
        yield from emptied(trie)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their texts: once a text has passed, all before it may go."""
        trie, last = Trie(), None
        for batch in batches:
            done = []
            for _, text, doc_id, part, m, n in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    done.append((0, None, doc_id, part, m, n))
                    continue
                if trie.held > HELD and text != last:
                    done.extend((0, None, node.least, p, k, c) for _, node in trie.terminals() for (p, k), c in node.rows.items())
                    trie = Trie()
                done.extend(beaten(trie.add(text, doc_id, (part, m), n), 0))
                last = text
            yield batch_of(done)
        yield batch_of([(0, None, node.least, p, k, c) for _, node in trie.terminals() for (p, k), c in node.rows.items()])

    dealt = rows.mapInArrow(local, schema).repartitionById(parts, F.col("place"))
    return dealt.sortWithinPartitions("text", "doc_id").mapInArrow(ranged, schema).select("doc_id", "part", "mask", "n")
