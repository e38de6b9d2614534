"""Repeated passages by an enhanced suffix array and its common-prefix interval tree.

A sparse suffix array: of every ``length`` bytes, the least hash of the ``GRAM``-byte grams among them is their
anchor, so equal strings of that length have equal anchors at the same place in them. The strings that share an anchor
start side by side; together they are the anchor's envelope, about 1.4 times ``length``. Anchors are sorted by gram and
envelope over ranges of equal weight:

* an envelope that occurs again is repeated as it stands (in copied text, nearly all are);
* a gram that occurs with other envelopes is open: its strings may repeat in part;
* all others have no string that starts anywhere else.

The open envelopes are read from the texts and joined by gram. A group's strings become an enhanced suffix array
(suffixes ranked by prefix doubling, common prefixes from the ranks), and a stack scan of it yields the intervals of the
common-prefix tree that reach ``length``: their suffixes are repeated. Grams with very many different envelopes are
not put into one task: their strings are counted by hash, summed before the shuffle.

Maximal repeats with all their occurrences are worked out from what is repeated (:func:`maximal_repeats`), to any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.llm.common import freeing, kept, tasks, whole
from marketlake.session import stored

GRAM = 50
CHUNK = 1 << 18  # bytes of a text that are hashed at a time; that takes a hundred times as much memory
LOW = 21  # bits of a place in a chunk
GROUP = 16_384  # envelopes of a gram that meet in one task, about 4 MB
BATCH = 1 << 18  # bytes from which a suffix array is built; that takes a hundred times as much memory
SPREAD = 1_000_000  # open envelopes up to which their places are broadcast, 40 MB; more are joined by shuffle

_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(77)
    base = int(r.integers(2**62, 2**63)) | 5
    inverse = pow(base, -1, 2**64)
    powers = np.empty(CHUNK + 1_024, _U)
    back = np.empty_like(powers)
    powers[0] = back[0] = 1
    with np.errstate(over="ignore"):
        powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, base, _U))
        back[1:] = np.multiply.accumulate(np.full(len(back) - 1, inverse, _U))
    return r.integers(0, 2**63, 256, np.uint64) * _U(2) + _U(1), powers, back


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on."""
    values, powers, back = kept("repeats", "gram tables", _tables)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(values[data] * powers[:len(data)], dtype=_U)))
    n = len(data) - gram + 1
    h = (sums[gram:] - sums[:n]) * back[:n]
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    n, step = len(x) - width + 1, 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step:width - step + n])


def anchors(data: bytes, length: int, gram: int = GRAM) -> np.ndarray:
    """Rows of place, hash, first and last start: the strings that share an anchor, over the whole text in order."""
    found, n, width = [], len(data) - length + 1, length - gram + 1
    whole_text = np.frombuffer(data, np.uint8)
    for at in range(0, n, CHUNK):
        part = whole_text[at:at + CHUNK + length - 1]
        h = _grams(part, gram)
        least = _least(((h >> _U(LOW)) << _U(LOW)) | np.arange(len(h), dtype=_U), width)
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        last = np.concatenate((first[1:], [len(least)])) - 1
        place = (least[first] & _U((1 << LOW) - 1)).astype(np.int64)
        found.append(np.stack([place + at, h[place].view(np.int64), first + at, last + at], 1))
    if not found:
        return np.empty((0, 4), np.int64)
    rows = np.concatenate(found)
    same = np.concatenate(([False], rows[1:, 0] == rows[:-1, 0]))  # a run cut by two chunks
    if same.any():
        starts = np.flatnonzero(~same)
        ends = np.concatenate((starts[1:], [len(rows)])) - 1
        last = rows[ends, 3]
        rows = rows[starts]
        rows[:, 3] = last
    return rows


ANCHOR = "gram long, envelope long, text_id long, first int, starts int"


def _anchored(length: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                columns = [[np.empty(0, np.int64)] for _ in kinds]
                for text_id, text in zip(some.column("text_id").to_pylist(), some.column("text")):
                    data = text.as_py().encode()
                    rows = anchors(data, length, gram)
                    view = memoryview(data)
                    place, h, first, last = rows.T
                    # What the strings are, and where in them the anchor is.
                    envelope = np.fromiter((digest(view[a:b + length]) for a, b in zip(first.tolist(), last.tolist())), _U, len(rows))
                    envelope ^= (place - first).astype(_U) * _U(0x9E3779B97F4A7C15)
                    for c, v in zip(columns, (h, envelope.view(np.int64), np.full(len(rows), text_id), first, last - first + 1)):
                        c.append(v)
                arrays = [pa.array(np.concatenate(c), pa.int64()).cast(k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["gram", "envelope", "text_id", "first", "starts"])
    return work


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of anchors in order: which are repeated as they stand, and which grams are open.

    ``repeated``: the envelope occurs again. ``open``: the gram has several envelopes; one anchor of each goes on, and
    all that are not repeated. Neighbours in other ranges are not seen, so what touches an end of the range is open.
    """
    def work(table: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
        """All rows of whole grams."""
        gram, envelope = table["gram"].to_numpy(), table["envelope"].to_numpy()
        new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
        new = new_gram | np.concatenate(([True], envelope[1:] != envelope[:-1]))
        of = np.cumsum(new) - 1
        repeated = np.bincount(of)[of] > 1
        of_gram = np.cumsum(new_gram) - 1
        several = np.bincount(of_gram, new)[of_gram] > 1
        edge = np.zeros(len(gram), bool)
        if ends:
            edge = (of_gram == 0) | (of_gram == of_gram[-1])
        opened = (several | edge) & (new | ~repeated)
        keep = repeated | opened
        return pa.RecordBatch.from_arrays([*table.columns, pa.array(repeated), pa.array(opened)],
                                          names=[*table.schema.names, "repeated", "opened"]).filter(pa.array(keep))

    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        gram = table["gram"].to_numpy()
        cut = len(gram) - int(np.argmax(gram[::-1] != gram[-1])) if gram[0] != gram[-1] else 0
        if cut:
            # The first gram of a range touches its end; so does the last, which is held.
            yield work(table.slice(0, cut), first)
            first = False
            held = table.slice(cut)
        elif len(gram) > 200_000:
            # One gram fills the range: its parts are judged like ranges.
            yield work(table, True)
            first, held = True, None
        else:
            held = table
    if held is not None:
        yield work(held, True)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on as one number, with zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(_U)


def suffix_array(eight: np.ndarray, left: np.ndarray, depth: int, wanted) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of suffixes by at least ``depth`` symbols or all of their string, and their ranks by 8, 16, ... symbols.

    ``eight``: the first symbols of all suffixes; ``left``: how many there are up to the 0 that ends the string. A suffix
    alone with its rank is settled, and so are those with no symbols left to rank by. Of the others, those that
    ``wanted(places, width)`` marks are ranked by ``width`` symbols, twice those before; the rest keep their order.
    A rank is the first place in the order of those that have it.
    """
    order = np.argsort(eight).astype(np.int32)
    rank, ranks, width = np.empty(len(order), np.int32), [], 8
    keys, at, places = eight[order], order, np.arange(len(order), dtype=np.int32)
    while True:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[at] = places[new][np.cumsum(new) - 1]
        ranks.append(rank)
        shared = ~(new & np.concatenate((new[1:], [True]))) & (left[at] > width)
        if width >= depth or not shared.any():
            return order, ranks
        places, at = places[shared], at[shared]
        shared = wanted(at, width * 2)
        places, at = places[shared], at[shared]
        if not len(at):
            return order, ranks
        keys = (rank[at].astype(_U) << _U(32)) | rank[at + width].astype(_U)
        by = np.argsort(keys)
        keys, at = keys[by], at[by]
        order[places] = at
        rank, width = rank.copy(), width * 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], eight: np.ndarray, length: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it in the order, from the ranks; the first has 0.

    Those that don't come to ``length`` may be given as shorter; those beyond the end of a string are for the caller to cut.
    """
    n = len(eight)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    common = np.zeros(len(order), np.int64)
    enough = [rank for level, rank in enumerate(ranks) if 8 << level <= length]
    some = np.flatnonzero(enough[-1][a] == enough[-1][b]) if enough else np.arange(len(a))
    a, b, found = a[some], b[some], np.zeros(len(some), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width, rank = 8 << level, ranks[level]
        same = np.maximum(a, b) < n
        same[same] = rank[a[same]] == rank[b[same]]
        step = same * width
        a, b, found = a + step, b + step, found + step
    inside = np.maximum(a, b) < n
    differ = eight[a[inside]] ^ eight[b[inside]]
    for i in range(1, 8):
        found[inside] += differ < _U(1 << (64 - 8 * i))
    common[some + 1] = found
    return common


def intervals(common: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals of at least ``length``, inner ones first: depth, first and last place in the order."""
    stack: list[tuple[int, int]] = []
    at = 0
    for at in np.flatnonzero(common >= length).tolist():
        depth = int(common[at])
        if stack and common[at - 1] < length:  # the order between holds nothing so deep
            end = ends
            while stack:
                deep, start = stack.pop()
                yield deep, start, end
        start = at - 1
        while stack and stack[-1][0] > depth:
            deep, start = stack.pop()
            yield deep, start, at - 1
        if not stack or stack[-1][0] < depth:
            stack.append((depth, start))
        ends = at
    while stack:
        deep, start = stack.pop()
        yield deep, start, at


class Envelopes:
    """Envelopes of some grams as an enhanced suffix array: the starts they stand for, in order, with common prefixes.

    Only the starts that an envelope stands for are suffixes here, so each place of a text is there once.
    """

    def __init__(self, rows: pa.RecordBatch, length: int):
        self.length = length
        texts, starts = rows["bytes"].to_pylist(), rows["starts"].to_numpy()
        sizes = np.array([len(t) for t in texts], np.int32)
        # Symbols 1 to 255 (no text has the byte 255), and 0 after each envelope, so that its end comes before all that goes on.
        ends = np.cumsum(sizes + 1)
        data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)
        owners = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
        withins = np.arange(len(data), dtype=np.int32) - (ends - sizes - 1).astype(np.int32)[owners]
        eight = eights(data)

        def wanted(at: np.ndarray, width: int) -> np.ndarray:
            """Starts, and what is multiples of ``width`` behind them."""
            return withins[at] % width < starts[owners[at]]

        order, ranks = suffix_array(eight, sizes[owners] + 1 - withins, int(sizes.max()) + 1, wanted)
        ordered = order[withins[order] < starts[owners[order]]]
        self.owner, self.within = owners[ordered], withins[ordered]
        limit = sizes[self.owner] - self.within
        self.common = np.minimum(common_prefixes(ordered, ranks, eight, length), limit)
        self.common[1:] = np.minimum(self.common[1:], limit[:-1])
        self.before = np.where(self.within > 0, data[np.maximum(ordered - 1, 0)].astype(np.int64) - 1, rows["left"].to_numpy()[self.owner])
        self.text, self.start = rows["text_id"].to_numpy()[self.owner], rows["first"].to_numpy()[self.owner] + self.within

    def depths(self) -> np.ndarray:
        """Of each place in the order, the depth of the innermost interval that holds it; 0 if none does."""
        found = np.zeros(len(self.common), np.int64)
        for depth, a, b in intervals(self.common, self.length):
            # Inner intervals come first and are deeper.
            np.maximum(found[a:b + 1], depth, out=found[a:b + 1])
        return found

    def repeats(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """Every interval: its depth, its places in the order, and whether it is maximal.

        It is if the bytes before its suffixes differ. A start of a text has -1 there, unlike any byte. At the first start
        of an envelope what is before belongs to another anchor, so there the repeat is the widest of this one.
        """
        for depth, a, b in intervals(self.common, self.length):
            before = self.before[a:b + 1]
            yield depth, np.arange(a, b + 1), bool(
                (before != before[0]).any() or before[0] < 0 or (self.within[a:b + 1] == 0).any())


OPEN = "gram long, text_id long, first int, starts int, left int, bytes binary"
SPAN = "text_id long, start int, stop int"
REPEAT = "repeat string, length int, text_id long, start int"


def _by_grams(batches: Iterator[pa.RecordBatch], work, schema: pa.Schema, by: str = "gram") -> Iterator[pa.RecordBatch]:
    """Sorted open envelopes, some whole grams at a time: ``BATCH`` bytes and what belongs to the last gram, however many come at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rows = max(1, batch.num_rows * BATCH // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            size += held[-1].nbytes
            if size < BATCH or held[0][by][0].as_py() == held[-1][by][-1].as_py():
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gram = table[by].to_numpy(zero_copy_only=False)
            cut = len(gram) - int(np.argmax(gram[::-1] != gram[-1]))
            yield from work(table.slice(0, cut), schema)
            held = [table.slice(cut)]
            size = held[0].nbytes
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks().to_batches()[0], schema)


def _spans(length: int):
    """Runs of bytes of each text that lie in occurrences of repeats."""
    schema = pa.schema([("text_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def work(rows: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        found = Envelopes(rows, length)
        covered = found.depths()
        hit = np.flatnonzero(covered)
        hit = hit[np.lexsort((found.start[hit], found.text[hit]))]
        text, start = found.text[hit], found.start[hit].astype(np.int64)
        stop = start + covered[hit]
        # Starts of one text that touch become one run.
        reach = np.maximum.accumulate(stop + (np.cumsum(np.concatenate(([0], text[1:] != text[:-1]))) << 33)) & ((1 << 33) - 1) if len(hit) else stop
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (start[1:] > reach[:-1]))) if len(hit) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(hit)])) - 1 if len(hit) else first
        yield pa.RecordBatch.from_arrays([pa.array(text[first]), pa.array(start[first], pa.int32()), pa.array(reach[last], pa.int32())], schema=schema)

    return lambda batches: _by_grams(batches, work, schema)


MEMBER = "class binary, text_id long, own long, start int, left int, depth int"
FAR = range(10, 21)  # members of a class are compared by hashes of so many powers of two of bytes
AHEAD = 1 << FAR[0]  # bytes that are compared themselves


def _starts(length: int):
    """A hash of every string in the repeated runs of a text, with the byte before it; -1 at the start of the text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data, spans = batch["text"][at].as_py().encode(), batch["spans"][at].values
                ends = np.zeros(len(data) + 1, np.int64)
                np.add.at(ends, spans.field(0).to_numpy(), 1)
                np.add.at(ends, spans.field(1).to_numpy() - (length - 1), -1)
                starts = np.flatnonzero(np.cumsum(ends))
                view = memoryview(data)
                for some in np.split(starts, range(50_000, len(starts), 50_000)):
                    strings = [xxhash.xxh3_128_digest(view[i:i + length]) for i in some.tolist()]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(strings, pa.binary()), pa.array([batch["text_id"][at].as_py()] * n, pa.int64()),
                         pa.array([batch["own"][at].as_py()] * n, pa.int64()), pa.array(some, pa.int32()),
                         pa.array([data[i - 1] if i else -1 for i in some.tolist()], pa.int32()), pa.array([0] * n, pa.int32())],
                        names=["class", "text_id", "own", "start", "left", "depth"])
    return work


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What comes in the texts after the depth of each member: the next bytes, and hashes of more of them."""
    names = ["class", "start", "left", "depth"]
    for batch in batches:
        for at in range(batch.num_rows):
            view = memoryview(batch["text"][at].as_py().encode())
            members = batch["members"][at].values
            for low in range(0, len(members), 5_000):
                some = members.slice(low, 5_000)
                columns = dict(zip(names, some.flatten()))
                near, far = [], [[] for _ in FAR]
                for begin in (columns["start"].to_numpy() + columns["depth"].to_numpy()).tolist():
                    near.append(bytes(view[begin:begin + AHEAD]))
                    state, done = xxhash.xxh3_128(), 0
                    for power, hashes in zip(FAR, far):
                        if begin + (1 << power) > len(view):
                            hashes.append(None)
                            continue
                        state.update(view[begin + done:begin + (1 << power)])
                        done = 1 << power
                        hashes.append(state.digest())
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [columns["class"], pa.array([batch["text_id"][at].as_py()] * n, pa.int64()), pa.array([batch["own"][at].as_py()] * n, pa.int64()),
                     columns["start"], columns["left"], columns["depth"], pa.array(near, pa.binary()), *(pa.array(h, pa.binary()) for h in far)],
                    names=["class", "text_id", "own", "start", "left", "depth", "bytes", *(f"h{p}" for p in FAR)])


def _alike(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _scanned(length: int):
    """Whole classes in order: the maximal repeats that end in the next bytes, and as new classes what goes on beyond them."""
    names = ["class", "text_id", "own", "start", "left", "depth", "hub_text", "hub_start", "done"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds)))

    def one(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = rows["bytes"].to_pylist()
        order = sorted(range(len(texts)), key=texts.__getitem__)
        # One more, so that a class whose next bytes differ at once is an interval too.
        common = np.array([0] + [_alike(texts[a], texts[b]) + 1 for a, b in zip(order, order[1:])])
        depth, name = rows["depth"][0].as_py(), rows["class"][0].as_py()
        text, own, start, left = (rows[c].to_numpy()[order] for c in ("text_id", "own", "start", "left"))
        for more, a, b in intervals(common, max(1, length - depth + 1)):
            if left[a] >= 0 and (left[a:b + 1] == left[a]).all():
                continue  # all can be extended to the left
            n, more = b + 1 - a, more - 1
            hub = a + int(np.lexsort((start[a:b + 1], text[a:b + 1]))[0])
            done = more < AHEAD
            key = name if done else xxhash.xxh3_128_digest(name + f"/{depth + more}/{text[hub]}/{start[hub]}".encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(
                    ([key] * n, text[a:b + 1], own[a:b + 1], start[a:b + 1], left[a:b + 1], [depth + more] * n, [text[hub]] * n, [start[hub]] * n, [done] * n),
                    kinds)], schema=schema)

    def work(rows: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        of = rows["class"].to_pylist()
        starts = [i for i in range(len(of)) if not i or of[i] != of[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(of)]):
            yield from one(rows.slice(a, b - a))

    return lambda batches: _by_grams(batches, work, schema, "class")


def _against_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large classes: how many of the next bytes they have in common with the hub of their class."""
    for batch in batches:
        common = [_alike(a, b) for a, b in zip(batch["bytes"].to_pylist(), batch["hub_bytes"].to_pylist())]
        names = [n for n in batch.schema.names if n != "hub_bytes"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(common, pa.int32())], names=[*names, "common"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of repeats, from a text that holds them."""
    for batch in batches:
        for at in range(batch.num_rows):
            data, wanted = batch["text"][at].as_py().encode(), batch["wanted"][at].values
            start, length = wanted.field(0), wanted.field(1)
            names = [hashlib.sha256(data[a:a + n]).hexdigest() for a, n in zip(start.to_pylist(), length.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch["text_id"][at].as_py()] * len(names), pa.int64()), start, length, pa.array(names)],
                names=["hub_text", "hub_start", "length", "repeat"])


def _cut_out(length: int):
    """The bytes of open envelopes, from the texts that hold them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch["text"][at].as_py().encode()
                places = batch["places"][at].values
                gram, first, starts = (places.field(i).to_numpy() for i in range(3))
                bytes_ = [data[a:a + n + length - 1] for a, n in zip(first.tolist(), starts.tolist())]
                left = [data[a - 1] if a else -1 for a in first.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array([batch["text_id"][at].as_py()] * len(gram), pa.int64()), pa.array(first), pa.array(starts),
                     pa.array(left, pa.int32()), pa.array(bytes_, pa.binary())],
                    names=["gram", "text_id", "first", "starts", "left", "bytes"])
    return work


def _strings(length: int):
    """A hash of every string of some envelopes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                view, n, first = memoryview(batch["bytes"][at].as_py()), batch["starts"][at].as_py(), batch["first"][at].as_py()
                h = [xxhash.xxh3_128_digest(view[i:i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.binary()), pa.array([batch["text_id"][at].as_py()] * n, pa.int64()),
                     pa.array(range(first, first + n), pa.int32())], names=["string", "text_id", "start"])
    return work


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts with an id of their own. Rows that repeat a document share it; what they hold is repeated anyway."""
    return docs.select(F.xxhash64(F.col(id_col).cast("long"), whole(text_col)).alias("text_id"), whole(text_col).alias("text"))


def _found(texts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Envelopes that are repeated as they stand; open ones of ordinary grams; open ones of grams with very many."""
    n = max(2, tasks(texts.sparkSession))
    rows = stored(texts.select("text_id", "text").mapInArrow(freeing(_anchored(length, gram)), ANCHOR), "anchors")
    order = ["gram", "envelope", "text_id", "first"]
    marked = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        freeing(_sorted_out), ANCHOR + ", repeated boolean, opened boolean")
    marked = stored(marked, "marked")
    opened = marked.filter("opened")
    several = opened.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    opened = stored(opened.select("gram", "text_id", "first", "starts").join(several, "gram"), "opened")
    places = opened.groupBy("text_id").agg(F.collect_list(F.struct("gram", "first", "starts")).alias("places"))
    places = F.broadcast(places) if opened.count() <= SPREAD else places
    # A gram with very many envelopes is told by its count, joined again to the envelopes.
    cut = stored(texts.select("text_id", "text").join(places, "text_id").select("text_id", "text", "places")
                 .mapInArrow(freeing(_cut_out(length)), OPEN), "envelopes")
    large = several.filter(F.col("n") > GROUP).select("gram")
    ordinary = cut.join(large, "gram", "left_anti").repartition(n, "gram").sortWithinPartitions("gram", "text_id", "first")
    return marked.filter("repeated"), ordinary, cut.join(large, "gram", "left_semi")


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text_id, start, stop``: runs of bytes covered by strings of ``length`` bytes that also start anywhere else.

    Runs of a text may overlap. Strings never cross texts.
    """
    return _repeated(_texts(docs, id_col, text_col), length, gram)


def _repeated(texts: DataFrame, length: int, gram: int) -> DataFrame:
    as_they_stand, ordinary, large = _found(texts, length, gram)
    spans = as_they_stand.select("text_id", F.col("first").alias("start"), (F.col("first") + F.col("starts") + (length - 1)).cast("int").alias("stop"))
    spans = spans.unionByName(ordinary.mapInArrow(freeing(_spans(length)), SPAN))
    strings = stored(large.mapInArrow(_strings(length), "string binary, text_id long, start int"), "strings")
    again = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    return spans.unionByName(strings.join(again, "string").select("text_id", "start", (F.col("start") + length).cast("int").alias("stop")))


def maximal_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``repeat, length, text_id, start``: all maximal repeats of ``length`` bytes or more, each with all its occurrences.

    A string is one if it occurs more than once, its occurrences are preceded by different bytes and followed by
    different bytes (the ends of a text are unlike any byte and each other). ``repeat`` is the SHA-256 of its bytes, ``length`` how many they are.
    Together they cover what :func:`repeated_spans` does: a repeated string, extended both ways while all its occurrences agree,
    is a maximal repeat that occurs as often. Rows that repeat a document have the same ``text_id`` and a row of the result each.

    Strings with equal first ``length`` bytes are a class. A class preceded by one byte only holds no maximal repeat: in
    copied text few are left. In each round the members of a class skip what hashes tell they have in common; then a
    class of bounded size is sorted by its next bytes and its prefix intervals are taken, and a larger one, wherever its
    members are, is held against its hub: what all have in common is a repeat, and the byte after it splits the class.
    """
    texts = _texts(docs, id_col, text_col).withColumnRenamed("text_id", "own").withColumn("text_id", F.monotonically_increasing_id())
    texts = stored(texts, "texts")
    n = max(2, tasks(texts.sparkSession))
    columns = [c.split()[0] for c in MEMBER.split(", ")]
    spans = _repeated(texts.select("text_id", "text"), length, gram).filter(F.col("stop") - F.col("start") >= length)
    spans = spans.groupBy("text_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    members = stored(texts.join(spans, "text_id").select("text_id", "own", "text", "spans").mapInArrow(_starts(length), MEMBER), "members")
    several = (F.count("*") > 1) & ((F.min("left") < F.max("left")) | (F.min("left") < 0))
    classes = members.groupBy("class").agg(several.alias("several")).filter("several").select("class")
    members = stored(members.join(classes, "class").select(columns), "members")
    group = ["hub_text", "hub_start", F.col("depth").alias("length"), "own", "start"]
    found = []
    while not members.isEmpty():
        of_text = members.groupBy("text_id").agg(F.collect_list(F.struct("class", "start", "left", "depth")).alias("members"))
        ahead = stored(texts.join(of_text, "text_id").select("text_id", "own", "text", "members").mapInArrow(
            _ahead, f"{MEMBER}, bytes binary, " + ", ".join(f"h{p} binary" for p in FAR)), "ahead")
        skip = F.lit(0)
        for p in FAR:
            skip = F.when((F.count(f"h{p}") == F.count("*")) & (F.min(f"h{p}") == F.max(f"h{p}")), 1 << p).otherwise(skip)
        classes = ahead.groupBy("class").agg(F.count("*").alias("n"), several.alias("several"), skip.alias("skip"))
        classes = stored(classes.filter("several").drop("several"), "classes")
        near = ahead.select(*columns, "bytes")
        rest = [ahead.select(columns).join(classes.filter("skip > 0").select("class", "skip"), "class")
                .withColumn("depth", F.col("depth") + F.col("skip")).select(columns)]
        small = near.join(classes.filter(f"skip = 0 and n <= {GROUP}").select("class"), "class")
        scanned = small.repartition(n, "class").sortWithinPartitions("class", "text_id", "start").mapInArrow(
            _scanned(length), f"{MEMBER}, hub_text long, hub_start int, done boolean")
        scanned = stored(scanned, "scanned")
        found.append(scanned.filter("done").select(group))
        rest.append(scanned.filter("not done").select(columns))
        large = classes.filter(f"skip = 0 and n > {GROUP}").select("class")
        if not large.isEmpty():
            # At most one in GROUP members is the hub of such a class.
            own = near.join(F.broadcast(large), "class")
            hubs = own.groupBy("class").agg(F.min(F.struct("text_id", "start", "bytes")).alias("hub"))
            hubs = hubs.select("class", F.col("hub.text_id").alias("hub_text"), F.col("hub.start").alias("hub_start"), F.col("hub.bytes").alias("hub_bytes"))
            held = own.join(F.broadcast(hubs), "class").select(*columns, "bytes", "hub_text", "hub_start", "hub_bytes")
            held = stored(held.mapInArrow(_against_hub, f"{MEMBER}, bytes binary, hub_text long, hub_start int, common int"), "held")
            split = held.drop("common").join(F.broadcast(held.groupBy("class").agg(F.min("common").alias("common"))), "class")
            split = split.withColumn("depth", F.col("depth") + F.col("common"))
            found.append(split.filter(F.col("depth") >= length).select(group))
            byte = F.hex(F.col("bytes").substr(F.col("common") + 1, F.lit(1)))
            name = F.unhex(F.md5(F.concat_ws("/", F.hex("class"), "depth", byte).cast("binary")))
            rest.append(split.filter(F.length("bytes") > F.col("common")).withColumn("class", name).select(columns))
        members = rest[0]
        for more in rest[1:]:
            members = members.unionByName(more)
        members = stored(members, "members")
    if not found:
        return texts.sparkSession.createDataFrame([], REPEAT)
    groups = found[0]
    for more in found[1:]:
        groups = groups.unionByName(more)
    hubs = groups.select("hub_text", "hub_start", "length").distinct()
    hubs = hubs.groupBy(F.col("hub_text").alias("text_id")).agg(F.collect_list(F.struct("hub_start", "length")).alias("wanted"))
    names = texts.join(hubs, "text_id").select("text_id", "text", "wanted").mapInArrow(
        _named, "hub_text long, hub_start int, length int, repeat string")
    return groups.join(names, ["hub_text", "hub_start", "length"]).select("repeat", "length", F.col("own").alias("text_id"), "start")


def _left_over(whole_characters: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"]):
                data, runs = text.as_py().encode(), []
                if spans.is_valid:
                    start, stop = (spans.values.field(i).to_numpy() for i in range(2))
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate(stop[order])
                    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                    runs = list(zip(start[new].tolist(), reach[np.concatenate((new[1:], [len(start)])) - 1].tolist()))
                ends = [0, *(x for run in runs for x in run), len(data)]
                parts = [data[a:b] for a, b in zip(ends[::2], ends[1::2])]
                n_left = sum(map(len, parts))
                if whole_characters:
                    parts = [x.decode("utf-8", "ignore").encode() for x in parts]
                rows.append((len(data), len(data) - n_left, len(runs), b"".join(parts)))
            n_bytes, removed, n_spans, left = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in batch.schema.names if n not in ("text", "spans")), pa.array(n_bytes, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(left, pa.binary())],
                names=[*(n for n in batch.schema.names if n not in ("text", "spans")), "n_bytes", "n_removed", "n_spans", "kept"])
    return work


def without_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                    whole_characters: bool = False) -> DataFrame:
    """``row`` (the document without its text), ``n_bytes, n_removed, n_spans, kept`` (the bytes left) for every document.

    Removed is each byte of the text (as UTF-8; null: empty) that is covered by a string of ``length`` bytes which also
    starts anywhere else, in the same document too; overlapping places count. Strings are judged on the whole input.
    Documents that repeat an id and a text are repeats of each other. A table without rows gives none. With
    ``whole_characters`` the bytes left of a character that was cut go too, so that ``kept`` is text.
    """
    spans = repeated_spans(docs, length, gram, id_col, text_col)
    by_text = spans.groupBy("text_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    own = F.xxhash64(F.col(id_col).cast("long"), whole(text_col)).alias("text_id")
    rows = docs.select(own, rest, whole(text_col).alias("text")).join(by_text, "text_id", "left")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType)])
    for name, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())):
        schema.add(name, kind)
    return rows.select("row", "text", "spans").mapInArrow(freeing(_left_over(whole_characters)), schema)
