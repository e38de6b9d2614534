"""Two tokenizers side by side: which tokens of one cover the bytes of the other's, and how often in the corpus.

Both token sequences of a text cut the same bytes. Where both end a token a group ends; between two neighbouring cuts of
either, one token of each lies, and that is a link. So a text has as many links as it has cuts.

How many documents hold a pair linked is read off an inverted index. For every pair there is a bitmap of documents, in
containers of ``SLOTS`` documents: sparse ones are lists of places, dense ones are bits. Workers OR the bitmaps of the
texts they read into the container's; containers of different tasks share no document, so counts of bits add up.
Multiplicity planes hold the bits of how often, beyond once, a document has the pair. The postings then take their
pair's count back to the documents: each set bit adds the count as often as its plane says.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import kept
from marketlake.session import stored

#: Documents of a container, places from which a bitmap is kept as bits, and bytes of such a bitmap.
SLOTS, DENSE, BITS = 4_096, 256, 512
#: Postings after which a container ends early, and bytes of text that are worked on together; both bound memory only.
POSTINGS, TOGETHER = 2_000_000, 1_000_000

#: Characters on whose classes all versions of Unicode in use agree, for the quick form of tokenizer A.
SETTLED = re.compile("[^\t\n\r -~¡-¬®-ſЀ-ҁ–—‘’“”…€"
                     "ぁ-ゖァ-ヺ一-龥가-힣]")

ROW = ("container long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
       "a int, b int, plane int, n int, bits binary")


class Cuts(NamedTuple):
    """Some texts, one after the other: their token ids, where tokens end, and the links."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    marks: np.ndarray  # by byte: 1 where a token of A ends, 2 where one of B does
    cuts: np.ndarray
    of_a: np.ndarray  # the token of A, by place, at every link
    of_b: np.ndarray


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: shown bytes as themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_source: str, b_model: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_source)
        self.a.encode_special_tokens = True
        of, vocabulary = _byte_of(), self.a.get_vocab(with_added_tokens=False)
        special = {t["content"] for t in json.loads(a_source).get("added_tokens") or ()}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            if token not in special:
                self.a_bytes[i] = bytes(of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        merges = [m if isinstance(m, list) else m.split(" ") for m in json.loads(a_source)["model"]["merges"]]
        ranks = {data: i for i, data in enumerate(self.a_bytes) if data}
        self.quick = None
        if all(vocabulary.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) and len(ranks) == 256 + len(merges):
            self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.shift = max(1, (len(self.b_bytes) - 1).bit_length())
        self._a_lengths, self._b_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        shown = [f"{i}{sep}" for n, seps in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for sep in seps for i in range(n)]
        self._shown = pa.array(shown, pa.large_binary())

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int], int] | None]:
        """The ids of both tokenizers and the length in bytes of each text; nothing where either gives other bytes."""
        found: list = [None] * len(texts)
        told = [i for i, t in enumerate(texts) if t]
        plain = [self.quick is not None and not SETTLED.search(texts[i]) for i in told]
        odd = iter(self.a.encode_batch([" " + texts[i] for i, p in zip(told, plain) if not p], add_special_tokens=False))
        b_ids = self.b.encode([texts[i] for i in told], num_threads=1)
        for i, p, b in zip(told, plain, b_ids):
            data = (" " + texts[i]).encode()
            a = self.quick.encode_ordinary(" " + texts[i]) if p else next(odd).ids
            if b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b)):
                found[i] = (a, b, len(data))
        return found

    def cuts(self, found: list[tuple[list[int], list[int], int]]) -> Cuts:
        """Both sequences of some texts on one line of bytes."""
        a, b = (np.fromiter(chain.from_iterable(f[k] for f in found), np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self._a_lengths[a]), np.cumsum(self._b_lengths[b])
        marks = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, np.uint8)
        marks[a_ends] = 1
        marks[b_ends] += 2
        at = np.flatnonzero(marks)
        in_a, in_b = marks[at] & 1, marks[at] >> 1
        return Cuts(a, b, a_ends, b_ends, marks, at, np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b)

    def shown(self, c: Cuts) -> tuple[np.ndarray, memoryview]:
        """All groups in writing, and where each token of both, group by group, begins in it."""
        both = np.flatnonzero(c.marks == 3)
        a_group, b_group = np.searchsorted(both, c.a_ends), np.searchsorted(both, c.b_ends)
        a_until, b_until = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=len(both))))) for g in (a_group, b_group))
        order = np.empty(len(c.a) + len(c.b), np.int64)
        order[np.arange(len(c.a)) + b_until[a_group]] = c.a + len(self.a_bytes) * (c.marks[c.a_ends] == 3)
        order[np.arange(len(c.b)) + a_until[b_group + 1]] = (
            2 * len(self.a_bytes) + c.b + len(self.b_bytes) * (c.marks[c.b_ends] == 3))
        text = self._shown.take(pa.array(order))
        buffers = text.buffers()
        return np.frombuffer(buffers[1], np.int64)[:len(text) + 1], memoryview(buffers[2] or b"")

    def groups(self, text: str | None) -> list[tuple[int, int, list[int], list[int]]]:
        """The groups of one text: first byte, byte after the last (of blank and text), ids of both."""
        found = self.tokens([text or ""])
        if found[0] is None:
            return []
        c = self.cuts(found)
        both = np.flatnonzero(c.marks == 3)
        a_at, b_at = np.searchsorted(c.a_ends, both, "right"), np.searchsorted(c.b_ends, both, "right")
        rows, last = [], (0, 0, 0)
        for end, i, j in zip(both.tolist(), a_at.tolist(), b_at.tolist()):
            rows.append((last[0], end, c.a[last[1]:i].tolist(), c.b[last[2]:j].tolist()))
            last = (end, i, j)
        return rows


class Container:
    """The bitmaps of up to ``SLOTS`` documents."""

    def __init__(self, number: int):
        self.number, self.used, self.held, self._pieces = number, 0, 0, []

    def add(self, postings: np.ndarray, times: np.ndarray) -> None:
        self._pieces.append((postings, times))
        self.held += len(postings)

    def rows(self, shift: int) -> Iterator[pa.RecordBatch]:
        """OR of all pieces: the bitmap of documents of every pair, and the planes of its multiplicities."""
        if not self._pieces:
            return
        postings, times = (np.concatenate(x) for x in zip(*self._pieces))
        order = np.argsort(postings)
        postings, beyond = postings[order], times[order] - 1
        plane = 0
        while len(postings):
            yield from self._plane(postings if not plane else postings[(beyond >> (plane - 1)) & 1 == 1], plane, shift)
            if not plane or (beyond >> plane).any():
                plane += 1
                postings, beyond = postings[beyond > 0], beyond[beyond > 0]
            else:
                return

    def _plane(self, postings: np.ndarray, plane: int, shift: int) -> Iterator[pa.RecordBatch]:
        if not len(postings):
            return
        pairs, slots = postings // SLOTS, (postings % SLOTS).astype("<u2")
        starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(pairs)])))
        dense = sizes >= DENSE
        of_dense = np.repeat(dense, sizes)
        ends = np.concatenate(([0], np.cumsum(2 * sizes[~dense]))).astype(np.int32)
        sparse = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(slots[~of_dense])])
        bits = np.zeros((int(dense.sum()), SLOTS), bool)
        bits[np.repeat(np.arange(len(bits)), sizes[dense]), slots[of_dense]] = True
        packed = pa.Array.from_buffers(pa.binary(), len(bits), [
            None, pa.py_buffer(np.arange(len(bits) + 1, dtype=np.int32) * BITS), pa.py_buffer(np.packbits(bits, axis=1, bitorder="little"))])
        for which, maps in ((~dense, sparse), (dense, packed)):
            if which.any():
                pair, n = pairs[starts[which]], sizes[which]
                yield _batch(len(n), container=np.full(len(n), self.number), a=pair >> shift, b=pair & ((1 << shift) - 1),
                             plane=np.full(len(n), plane), n=n, bits=maps)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(size: int, **columns) -> pa.RecordBatch:
    """Rows of ``ROW`` with nulls in the columns that are not given."""
    fields = [f.split() for f in ROW.split(", ")]
    made = [pa.nulls(size, _KINDS[kind]) if name not in columns else
            columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], _KINDS[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(made, names=[name for name, _ in fields])


def _aligner(spark, a_path: str, b_path: str, pattern: str):
    """Both vocabulary files for the workers: read once by the driver, two megabytes whatever the data."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shipped = spark.sparkContext.broadcast((f.read(), g.read()))
    return lambda: kept("alignment", f"aligner {a_path} {b_path}", lambda: Aligner(*shipped.value, pattern))


def _index(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Rows of documents with their digests, and rows of bitmaps by pair and container."""
    ready = _aligner(docs.sparkSession, a_path, b_path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, first = ready(), TaskContext.get().partitionId() << 32
        container = Container(first)
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(texts):
                if container.used == SLOTS or container.held >= POSTINGS:
                    yield from container.rows(aligner.shift)
                    container = Container(container.number + 1)
                end, size = at, 0
                while end < len(texts) and end - at < SLOTS - container.used and (end == at or size + len(texts[end] or "") <= TOGETHER):
                    size += len(texts[end] or "")
                    end += 1
                yield _read(aligner, container, ids[at:end], [t or "" for t in texts[at:end]])
                at = end
        yield from container.rows(aligner.shift)

    return docs.mapInArrow(work, ROW)


def _read(aligner: Aligner, container: Container, ids: list, texts: list[str]) -> pa.RecordBatch:
    """Some documents into the container; gives their own rows."""
    found = aligner.tokens(texts)
    told = [i for i, f in enumerate(found) if f is not None]
    sizes = {name: np.zeros(len(ids), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    shown = [""] * len(ids)
    if told:
        c = aligner.cuts([found[i] for i in told])
        ends = np.cumsum([found[i][2] for i in told])
        both = np.flatnonzero(c.marks == 3)
        for name, at in (("n_a", c.a_ends), ("n_b", c.b_ends), ("n_groups", both), ("n_links", c.cuts)):
            sizes[name][told] = np.diff(np.concatenate(([0], np.searchsorted(at, ends, "right"))))
        starts, data = aligner.shown(c)
        stops = np.cumsum(sizes["n_a"][told] + sizes["n_b"][told])
        for i, start, stop in zip(told, [0, *starts[stops[:-1]].tolist()], starts[stops].tolist()):
            shown[i] = hashlib.sha256(data[start:stop - 1]).hexdigest()
        slots = np.repeat(container.used + np.array(told, np.int64), sizes["n_links"][told])
        pairs = (c.a[c.of_a] << aligner.shift) | c.b[c.of_b]
        container.add(*np.unique(pairs * SLOTS + slots, return_counts=True))
    rows = _batch(len(ids), container=np.full(len(ids), container.number), slot=np.arange(container.used, container.used + len(ids)),
                  doc_id=pa.array(ids, pa.int64()), groups_sha256=shown, **sizes)
    container.used += len(ids)
    return rows


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with their pair's count, container by container, to sums of the documents."""
    number, sums = None, None

    def done() -> pa.RecordBatch:
        slots = np.flatnonzero(sums[2])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(slots), number), pa.int64()), pa.array(slots, pa.int32()), pa.array(sums[0][slots]), pa.array(sums[1][slots])],
            names=["container", "slot", "n_best", "count_sum"])

    for batch in batches:
        containers, planes, counts, best, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        bits = batch.column(5)
        starts = np.flatnonzero(np.concatenate(([True], containers[1:] != containers[:-1]))) if len(containers) else []
        for start, stop in zip(starts, [*starts[1:], len(containers)]):
            if containers[start] != number:
                if number is not None:
                    yield done()
                number, sums = int(containers[start]), np.zeros((3, SLOTS), np.int64)
            weights = 1 << np.maximum(planes[start:stop].astype(np.int64) - 1, 0)
            part, n = bits.slice(start, stop - start), sizes[start:stop].astype(np.int64)
            for dense in (False, True):
                which = (n >= DENSE) == dense
                if not which.any():
                    continue
                data = b"".join(part.filter(pa.array(which)).to_pylist())
                if dense:
                    rows, slots = np.nonzero(np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, BITS), axis=1, bitorder="little"))
                else:
                    rows, slots = np.repeat(np.arange(int(which.sum())), n[which]), np.frombuffer(data, "<u2")
                weight = weights[which][rows]
                np.add.at(sums[0], slots, weight * best[start:stop][which][rows])
                np.add.at(sums[1], slots, weight * counts[start:stop][which][rows])
                np.add.at(sums[2], slots, weight)
    if number is not None:
        yield done()


class Aligned(NamedTuple):
    documents: DataFrame  # doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    pairs: DataFrame  # a, b, n_docs, n_links, best


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> Aligned:
    """The links of every document, and how many documents hold each pair of ids linked.

    A is a byte-level BPE file of the ``tokenizers`` library, read with a blank before the text; B is a sentencepiece
    model, which adds that blank. Strings of special tokens are plain text. Texts that are null or empty, or whose tokens
    do not give back their bytes, have no tokens: zeros and an empty digest. ``best`` marks the pairs of an id of A
    that the most documents hold, ties included. Rows that repeat an id are documents of their own; a very long text is
    worked on whole. An empty table gives no row in either result. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = stored(_index(texts, a_path, b_path, pattern), "postings")
    postings = index.filter("plane is not null").select("container", "a", "b", "plane", "n", "bits")
    weight = F.expr("shiftleft(1L, greatest(plane - 1, 0))")
    counted = postings.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum(F.col("n") * weight).alias("n_links"))
    counted = stored(counted, "pairs")
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    pairs = counted.join(most, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("best"))
    # the table of pairs grows with the vocabulary in use, so it is never broadcast
    told = postings.join(pairs.drop("n_links").hint("merge"), ["a", "b"]).select("container", "plane", "n_docs", "best", "n", "bits")
    sums = told.repartition("container").sortWithinPartitions("container").mapInArrow(
        _scores, "container long, slot int, n_best long, count_sum long")
    rows = index.filter("plane is null").join(sums, ["container", "slot"], "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return Aligned(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256"), pairs)


def groups(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: a row for each, with its bytes' place in blank and text, and the ids of both tokenizers."""
    ready = _aligner(docs.sparkSession, a_path, b_path, pattern)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["doc_id", "group", "start", "stop", "a", "b"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = ready()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(doc_id, i, *g) for i, g in enumerate(aligner.groups(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(work, "doc_id long, group int, start long, stop long, a array<int>, b array<int>")
