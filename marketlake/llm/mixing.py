"""Online logistic context mixing: the probability of a text, bit by bit.

A text is its lower-cased words, each ended by a blank, and a line feed at the end. Symbols are bytes in a prefix code
fitted to the corpus, so a symbol is a few binary decisions. For every decision several predictors look up, in hashed
tables, how often either side was taken in their context: the last two to four symbols of the word, all of the word so
far, and, for the first symbols of a word, these with a hash of the last short word before (short words tell languages
and phrases apart). What a predictor has counted becomes a number by a map of states; the numbers are combined by weights
that a gate chooses, by how much the longest contexts know; the sum is refined by an adaptive map, and in each document by
its own choice, as the text goes by, among three degrees of confidence and two shares for the words it has had before (a
Bayes mixture, so its product has a closed form).

Spark gathers the corpus: exact counts of words and of beginnings of words, which grow with it, then counts of contexts
and symbols, of which each range of the tables is built in one task. The tables have a fixed size: of contexts that meet
in a place the more frequent one keeps it. Words end contexts, so a word's bits are worked out once for many texts.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import freeing, released, whole
from marketlake.session import BATCH, stored

#: Parameters of the model. Classes of the short word before, bytes of a short word, symbols after which contexts start
#: anew, symbols of a word that see the class, and for each predictor the places of its table (a power of two; four bytes each).
CLASSES, SHORT, PIECE, HEAD = 254, 3, 64, 3
PLACES = (18, 20, 21, 22, 20)
#: Words whose counts every worker has; the counts of all others come by a join.
FREQUENT = 1 << 18
#: Entries that a task draws from the lexicon at a time to learn from; it bounds memory only, all of them are learned from.
DRAWS = 5_000
#: Decisions in a row of a table: Parquet puts a hundred rows at least into a page and compresses it outside the heap.
CELL = 4_096
#: Such rows that a task learns from at least, if there are as many: each task sends all of its sums.
CELLS = 64
#: Newton's method for the weights: how strongly they hold to where they begin, the gain by decision at which it ends, steps at most.
HOLD, GAIN, NEWTON = 20.0, 1e-5, 12
#: Characters whose words are counted and are worked out together, and keys a task holds; all bound memory only.
COUNTED, TOGETHER, KEYS = 2_000_000, 5_000_000, 1_500_000

BLANK, END = 0x20, 0x0A
CONT = CLASSES + 1  # the class of a piece that goes on with a word
ORDERS = (2, 3, 4)  # symbols of the first predictors' contexts
SO_FAR, OPENING = len(ORDERS), len(ORDERS) + 1  # the predictors of the word so far, and of its beginning with the class before
TABLES = OPENING + 1
SHARDS = 1 << 10
LEVELS = 6
LEVEL_OF = np.digitize(np.arange(23), [1, 4, 8, 14, 22])
GATES, STEPS = 16 * LEVELS, 33
CONFIDENCE, PLAIN = np.array([0.8, 1.0, 1.2]), 1
OWN = (0.1, 0.3)  # shares of the document's own words
#: Kinds of entries: words, digests of longer ones, pieces of these, beginnings by class, ends of texts.
WORD, LONG, PART, BEGIN, STOP = range(5)

#: The counts that four bits can say, and those that twelve bits can, 150 for each power of two.
COUNTS = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512, 2048, 8192])
FINE = np.exp2(np.arange(4096) / 150) - 1
LEAN = 8_192
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(32)
    return x * _M2


class Code(NamedTuple):
    """A prefix code of the bytes: by symbol the number of decisions, where they begin, and each one's node and side."""

    sizes: np.ndarray
    starts: np.ndarray
    nodes: np.ndarray
    sides: np.ndarray


def code(counts: np.ndarray) -> Code:
    """The code of least length for these counts and one more of each."""
    heap = [(int(n) + 1, s, s) for s, n in enumerate(counts)]
    heapq.heapify(heap)
    above, node = {}, 256
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a], above[b] = (node, 0), (node, 1)
        heapq.heappush(heap, (n + m, node, node))
        node += 1
    paths = []
    for s in range(256):
        path, at = [], s
        while at in above:
            path.append(above[at])
            at = above[at][0]
        paths.append(path[::-1])
    sizes = np.array([len(p) for p in paths])
    nodes, sides = np.array([step for p in paths for step in p]).T
    return Code(sizes, np.cumsum(sizes) - sizes, nodes.astype(np.uint64) - np.uint64(256), sides.astype(np.uint8))


class Symbols(NamedTuple):
    """Entries one after the other: their symbols, each one's place in its entry, and each one's entry."""

    data: np.ndarray
    at: np.ndarray
    of: np.ndarray


def symbols(data: np.ndarray, sizes: np.ndarray) -> Symbols:
    of = np.repeat(np.arange(len(sizes)), sizes)
    return Symbols(data, np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of)


def ended(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, each with a blank after it, and their sizes."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    sizes = np.diff(offsets) + 1
    data = np.full(int(sizes.sum()), BLANK, np.uint8)
    keep = np.ones(len(data), bool)
    keep[np.cumsum(sizes) - 1] = False
    data[keep] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(words) else 0
    return data, sizes


def contexts(s: Symbols, classes: np.ndarray) -> list[np.ndarray]:
    """The context of every symbol for each predictor, in 40 bits. ``classes``: that of the word before, by entry."""
    at = s.at % PIECE
    value = s.data.astype(np.uint64) + np.uint64(1)
    found, last = [], np.zeros(len(value), np.uint64)
    for k in range(1, ORDERS[-1] + 1):
        earlier = np.zeros(len(value), np.uint64)
        earlier[k:] = value[:-k] if len(value) > k else 0
        earlier[at < k] = 0
        last = last | (earlier << np.uint64(9 * (k - 1)))
        if k in ORDERS:
            found.append(_mix(last * np.uint64(8) + np.uint64(k)) >> np.uint64(24))
    powers = np.cumprod(np.full(PIECE, _M2, np.uint64))
    until = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * powers[at])))
    here = np.arange(len(value))
    so_far = until[here] - until[here - at]
    found.append(_mix(so_far * np.uint64(8) + np.uint64(5)) >> np.uint64(24))
    known = np.where(s.at < PIECE, classes[s.of] if len(s.of) else 0, CONT).astype(np.uint64)
    found.append(_mix(so_far * np.uint64(1024) + known * np.uint64(8) + np.uint64(7)) >> np.uint64(24))
    return found


def _fine(n: np.ndarray) -> np.ndarray:
    """A count in twelve bits."""
    return np.minimum(np.rint(150 * np.log2(n + 1.0)), 4095).astype(np.uint32)


def _coarse() -> np.ndarray:
    """From twelve bits to four."""
    return (np.searchsorted(COUNTS, np.rint(FINE), "right") - 1).astype(np.uint8)


def pack(ctx: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (context, symbol), summed, as sorted keys and numbers."""
    key = ctx << np.uint64(8) | symbol.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    return key[starts], np.add.reduceat(n[order], starts) if len(key) else n


def places(shard: int, packed: np.ndarray, c: Code) -> np.ndarray:
    """One range of a table from its counts: 32 bits a place, of which 8 check the context and 12 are the count of either side."""
    n = (packed & np.uint64((1 << 26) - 1)).astype(np.int64)
    key, n = pack(packed >> np.uint64(34), (packed >> np.uint64(26)) & np.uint64(255), n)
    ctx = key >> np.uint64(8)
    starts = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    total = np.add.reduceat(n, starts)
    keep = np.repeat(total >= 2, np.diff(np.concatenate((starts, [len(ctx)]))))  # a context met once says nothing
    ctx, symbol, n = ctx[keep], (key[keep] & np.uint64(255)).astype(np.int64), n[keep]
    size = PLACES[shard // SHARDS]
    made = np.zeros((1 << size) // SHARDS, np.uint32)
    if not len(ctx):
        return made
    sizes = c.sizes[symbol]
    rep = np.repeat(np.arange(len(ctx)), sizes)
    step = np.arange(len(rep)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + c.starts[symbol][rep]
    full = (np.uint64(shard % SHARDS) << np.uint64(30)) | ctx[rep]
    h = _mix(full * np.uint64(256) + c.nodes[step])
    order = np.argsort(h)
    h, n, side = h[order], n[rep][order], c.sides[step][order]
    at = _place(full[order], h, size) % len(made)
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    n1, both = np.add.reduceat(n * side, starts), np.add.reduceat(n, starts)
    h, at = h[starts], at[starts]
    order = np.lexsort((h, -both, at))
    first = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))]
    made[at[first]] = _fine(both[first] - n1[first]) | _fine(n1[first]) << np.uint32(12) | _check(h[first]) << np.uint32(24)
    return made


def _place(ctx: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Where a decision of a context stands in a table: contexts of a range stay together."""
    return ((ctx >> np.uint64(48 - size)) << np.uint64(8) | h >> np.uint64(56)).astype(np.int64)


def _check(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(48)) & np.uint64(255)).astype(np.uint32)


def _stretch(p):
    return np.log(p / (1 - p))


def packed(fine: np.ndarray, sides: np.ndarray | None = None) -> np.ndarray:
    """Two fine counts as the state of the coarse ones and how far the finer ones lean beyond it; checks stay.

    With ``sides`` the counts are those before that one decision was counted, as of :func:`_without_one`.
    """
    low, high, coarse, beyond = fine & np.uint32(4095), (fine >> np.uint32(12)) & np.uint32(4095), _coarse(), _beyond()
    if sides is not None:
        less, own = _less(), sides.astype(np.uint32) << np.uint32(12)
        coarse, beyond = (np.concatenate((x, x[less])) for x in (coarse, beyond))
        low, high = low | (own ^ np.uint32(4096)), high | own
    lean = np.rint((beyond[high] - beyond[low]) * LEAN).astype(np.int16).view(np.uint16).astype(np.uint32)
    state = (coarse[low] | coarse[high] << np.uint8(4)).astype(np.uint32)
    return (fine & np.uint32(0xFF000000)) | state << np.uint32(16) | lean


def decisions(c: Code, tables: list[np.ndarray], s: Symbols, classes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decisions of the symbols ``which``: what every predictor has in its place, the sides taken, each one's entry."""
    sizes = c.sizes[s.data[which]]
    step = _steps_of(c, s.data[which])
    node = c.nodes[step] * _M1
    found = np.zeros((TABLES, len(step)), np.uint32)
    opening = s.at[which] % PIECE < HEAD
    some = np.flatnonzero(np.repeat(opening, sizes))
    for i, (table, ctx) in enumerate(zip(tables, contexts(s, classes))):
        full, many, at_node = ctx[which], sizes, node
        if i == OPENING and not len(some):
            continue
        if i == OPENING and len(some) < len(step):
            full, many, at_node = full[opening], sizes[opening], node[some]
        h = np.repeat(full * (_M1 << np.uint64(8)), many)  # as _mix(full * 256 + node)
        h += at_node
        h ^= h >> np.uint64(32)
        h *= _M2
        h >>= np.uint64(48)
        place = np.repeat((full >> np.uint64(48 - PLACES[i])) << np.uint64(8), many)
        place |= h >> np.uint64(8)
        had = table[place.view(np.int64)]
        same = (had >> np.uint32(24)).astype(np.uint8) == h.astype(np.uint8)
        had &= np.uint32(0xFFFFFF)
        had *= same
        if len(had) == len(step):
            found[i] = had
        else:
            found[i][some] = had
    return found, c.sides[step], np.repeat(s.of[which], sizes)


def _steps_of(c: Code, symbol: np.ndarray) -> np.ndarray:
    """Where the code has the decisions of some symbols, one after the other."""
    sizes = c.sizes[symbol]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(c.starts[symbol] - ends + sizes, sizes)


def told_apart(s: Symbols, kinds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are the same after the same beginning, in entries next to each other of one kind, need to be worked out once.

    ``which`` takes the same places of all entries of a kind. Gives the distinct ones, and for each of ``which`` its like's
    number among them. Of sorted entries these are the nodes of their tree; the order matters to the work only.
    """
    if not len(s.data):
        return which, which
    sizes = np.bincount(s.of)
    starts = np.cumsum(sizes) - sizes
    alike = np.concatenate(([0], np.where(kinds[1:] == kinds[:-1], np.minimum(sizes[:-1], PIECE), 0)))  # places to compare
    over = s.at >= alike[s.of]
    before = np.where(over, 0, (np.concatenate(([0], starts[:-1])) - starts)[s.of] + np.arange(len(s.data)))
    over |= s.data[before] != s.data
    common = np.minimum.reduceat(np.where(over, s.at, len(s.data)), starts)  # symbols shared with the entry before
    order = np.argsort(np.minimum(s.at, 255).astype(np.uint8), kind="stable")  # place by place, in the order of the entries
    own = (s.at >= common[s.of])[order]
    first = np.empty(len(s.data), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(own, np.arange(len(own)), 0))]
    used = np.zeros(len(s.data), bool)
    used[first[which]] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[first[which]]


class Model(NamedTuple):
    """What workers need: four bytes for each of ``PLACES``, about 34 MB, whatever the corpus."""

    code: Code
    tables: list[np.ndarray]  # packed
    maps: np.ndarray  # predictor, level and state -> number
    weights: np.ndarray  # gate, predictor (the last is constant)
    refined: np.ndarray  # gate, step -> number

    def inputs(self, found: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The predictors' numbers, and the gate: what the word so far and the last four symbols have counted, and the level.

        A number is what the map has for the state, moved by what the finer counts say beyond it.
        """
        above = level * 256
        numbers = np.empty((TABLES + 1, found.shape[1]), np.float32)
        for i in range(TABLES):
            self._input(found[i], above, i, numbers[i])
        numbers[TABLES] = 0.3
        return numbers, _gate(found, level)

    def _input(self, found: np.ndarray, above: np.ndarray, i: int, number: np.ndarray) -> None:
        number[:] = found.astype(np.uint16).view(np.int16)
        number *= np.float32(1 / LEAN)
        number += self.maps[i].take(above + (found >> np.uint32(16)))

    def mixed(self, found: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The refined number of every decision: over zero where the second side is likelier."""
        above, gate, weights = level * 256, _gate(found, level), np.ascontiguousarray(self.weights.T)
        x, number = np.zeros(found.shape[1], np.float32), np.empty(found.shape[1], np.float32)
        for i in range(TABLES):
            if found[i].any():  # nothing counted is the number zero
                self._input(found[i], above, i, number)
                number *= weights[i].take(gate)
                x += number
        x += weights[TABLES].take(gate) * np.float32(0.3)
        low, part = _steps(x)
        low += gate * STEPS
        refined = self.refined.ravel()
        return 0.5 * x + 0.5 * ((1 - part) * refined.take(low) + part * refined.take(low + 1))

    def bits(self, s: Symbols, classes: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """Natural logarithms of the probabilities of the entries' symbols ``which``, for each degree of confidence."""
        found = np.zeros((n, len(CONFIDENCE)))
        if len(which):
            own, like = told_apart(s, classes, which)
            counted, sides, _ = decisions(self.code, self.tables, s, classes, own)
            sizes = self.code.sizes[s.data[own]]
            level = levels_of(counted[SO_FAR] >> np.uint32(16), sides, sizes, like, s.of[which])
            x = np.where(sides, np.float32(-1), np.float32(1)) * self.mixed(counted, level)
            starts = np.cumsum(sizes) - sizes
            for k, confidence in enumerate(CONFIDENCE):
                each = np.add.reduceat(np.log(np.float32(1) + np.exp(x * np.float32(confidence))), starts, dtype=float)
                found[:, k] = -np.bincount(s.of[which], each[like], n)
        return found


def _beyond() -> np.ndarray:
    """How much a count is above the coarse one that stands for it, as a logarithm."""
    return np.log((FINE + 0.4) / (COUNTS[_coarse()] + 0.4)).astype(np.float32)


def levels(state: np.ndarray, sides: np.ndarray, of: np.ndarray) -> np.ndarray:
    """By decision, for how many decisions of its entry before it the word so far knew one side only, and rightly."""
    return LEVEL_OF.take(np.minimum(_run(_right(state, sides), of), len(LEVEL_OF) - 1))


def levels_of(state: np.ndarray, sides: np.ndarray, sizes: np.ndarray, like: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """These, for distinct symbols of so many decisions; entries are made of symbols, each ``like`` one of them."""
    right, ends = _right(state, sides), np.cumsum(sizes)
    run = _run(right, np.repeat(np.arange(len(sizes)), sizes))
    at_end = np.where(right[ends - 1], run[ends - 1] + 1, 0)[like]
    size = sizes[like]
    gone = np.cumsum(size) - size
    begins = np.concatenate(([True], entry[1:] != entry[:-1]))
    known = np.where(begins, 0, np.concatenate(([0], at_end[:-1])))
    since = np.maximum.accumulate(np.where(begins | np.concatenate(([True], (at_end != size)[:-1])), np.arange(len(like)), 0))
    before = np.empty(len(sizes), np.int64)
    before[like] = known[since] + gone - gone[since]
    inside = np.arange(len(run)) - np.repeat(ends - sizes, sizes)
    run += np.where(run == inside, np.repeat(before, sizes), 0)
    return LEVEL_OF.take(np.minimum(run, len(LEVEL_OF) - 1))


def _right(state: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether one side only was known, and was taken."""
    return (state > 0) & np.where(sides == 0, state < 16, state & 15 == 0)


def _run(right: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many before each, one after the other and of the same number, are right."""
    at = np.arange(len(right))
    begins = np.concatenate(([True], of[1:] != of[:-1]))
    return at - np.maximum.accumulate(np.where(np.concatenate(([False], ~right[:-1])) | begins, at, 0))


def _sure() -> np.ndarray:
    """By state, how much it has counted: nothing, one, two to four, more."""
    every = np.arange(256)
    total = COUNTS[every & 15] + COUNTS[every >> 4]
    return np.digitize(total, [1, 2, 5]).astype(np.int64)


def _gate(found: np.ndarray, level: np.ndarray) -> np.ndarray:
    sure = _sure()
    return (sure[found[SO_FAR] >> np.uint32(16)] * 4 + sure[found[SO_FAR - 1] >> np.uint32(16)]) * LEVELS + level


def _steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = np.clip(x, -7.99, 7.99) * np.float32(2) + np.float32(16)
    low = y.astype(np.int64)
    return low, y - low


def _less() -> np.ndarray:
    """From twelve bits to those of a count less by one."""
    return _fine(np.maximum(np.where(FINE < 1_000, np.rint(FINE), FINE) - 1, 0))


def _without_one(counted: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The counts as they were before one decision was counted."""
    less = _less()
    low, high = counted & np.uint32(4095), counted >> np.uint32(12)
    return np.where(sides == 0, less[low] | high << np.uint32(12), low | less[high] << np.uint32(12))


def _prior() -> np.ndarray:
    """By state, the share of the second side."""
    every = np.arange(256)
    n0, n1 = COUNTS[every & 15], COUNTS[every >> 4]
    return (n1 + 0.4) / (n0 + n1 + 0.8)


def begun(c: Code) -> Model:
    """A model that has learned nothing yet, without tables."""
    maps = np.tile(np.where(np.arange(256) == 0, 0.0, _stretch(_prior())), (TABLES, LEVELS))
    weights = np.full((GATES, TABLES + 1), 0.3)
    weights[:, TABLES] = 0.0
    steps = (np.arange(STEPS) - 16) / 2.0
    return Model(c, [], maps.astype(np.float32), weights.astype(np.float32), np.tile(steps, (GATES, 1)).astype(np.float32))


DECIDED = "found binary, level binary, side binary, n binary"


def _decided(c: Code, fine: list[np.ndarray], kinds: np.ndarray, entries: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    """The decisions of some entries: what the tables have without the entry itself, level, side, and how often; equal ones once.

    Rows (``DECIDED``) of up to ``CELL`` decisions.
    """
    s, classes, begins = _entry_symbols(kinds, entries)
    which = np.flatnonzero(begins[s.of] | (s.at >= HEAD))  # beginnings have a class, words are told from there on
    own, like = told_apart(s, classes * 2 + begins, which)
    found, sides, _ = decisions(c, fine, s, classes, own)
    sizes = c.sizes[s.data[own]]
    found, n = packed(found, sides), np.repeat(np.bincount(like, n[s.of[which]].astype(float), len(own)), sizes)
    level = levels_of(found[SO_FAR] >> np.uint32(16), sides, sizes, like, s.of[which])
    gate = _gate(found, level)
    key = (gate * 2 + sides).astype(np.uint64)
    for row in found:
        key = _mix(key ^ row.astype(np.uint64))
    key = gate.astype(np.uint64) << np.uint64(57) | key >> np.uint64(7)  # gates stay together
    order = np.argsort(key)
    key, found, sides = key[order], found[:, order], sides[order]
    other = (key[1:] != key[:-1]) | (sides[1:] != sides[:-1])  # other decisions may have the key, too
    for row in found:
        other |= row[1:] != row[:-1]
    starts = np.flatnonzero(np.concatenate(([True], other))) if len(key) else np.zeros(0, int)
    n = np.add.reduceat(n[order], starts) if len(key) else n
    made = (found[:, starts], level[order[starts]].astype(np.uint8), sides[starts], n)
    cells = [[x[..., at:at + CELL].tobytes() for at in range(0, len(starts), CELL)] for x in made]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in cells], names=["found", "level", "side", "n"])


def _learned(rows: DataFrame, cells: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``work(found, level, sides, n)``, so many cells, over all decisions; a task sends one row for each cell."""
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                found, level, sides, n = (c.to_pylist() for c in batch.columns)
                total += work(np.concatenate([np.frombuffer(x, np.uint32).reshape(TABLES, -1) for x in found], axis=1),
                              np.frombuffer(b"".join(level), np.uint8).astype(np.int64), np.frombuffer(b"".join(sides), np.uint8),
                              np.frombuffer(b"".join(n), float))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], names=["cell", "x"])

    sums = rows.mapInArrow(freeing(some), "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(cells)
    total[np.array(sums.column("cell"), int)] = np.array(sums.column("x"), float)
    return total


def learn(c: Code, fine: list[np.ndarray], rows: DataFrame | Sequence) -> Model:
    """Maps, weights and refinement from all decisions of the lexicon (``DECIDED``), each as often as it came; no rows teach nothing.

    Each is a sum over the decisions: of sides by state for the maps; for the weights of a gate, a logistic regression,
    of slopes and curvatures, a Newton step at a time; of sides by mixed number for the refining map. So they do not
    depend on how the lexicon lies in partitions.
    """
    tables, prior, width = [packed(table) for table in fine], _prior(), 256 * LEVELS
    model = begun(c)
    if not isinstance(rows, DataFrame):
        return model._replace(tables=tables)
    rows = rows.coalesce(max(1, -(-rows.count() // CELLS)))

    def by_state(found, level, sides, n):
        at = [level * 256 + (row >> np.uint32(16)) for row in found]
        return np.concatenate([np.bincount(a, x, width) for a in at for x in (n * sides, n)])

    sums = _learned(rows, TABLES * 2 * width, by_state).reshape(TABLES, 2, LEVELS, 256)
    ones, all_ = sums[:, 0], sums[:, 1]
    far = (ones.sum(1) + 4 * prior) / (all_.sum(1) + 4)
    maps = np.where(np.arange(256) == 0, 0.0, _stretch((ones + 8 * far[:, None]) / (all_ + 8)))
    model = model._replace(maps=maps.reshape(TABLES, width).astype(np.float32))
    model = model._replace(weights=_weights(rows, model).astype(np.float32))

    def by_step(found, level, sides, n):
        numbers, gate = model.inputs(found, level)
        low, rest = _steps((model.weights[gate].T * numbers).sum(0))
        parts = [(gate * STEPS + low, 1 - rest), (gate * STEPS + low + 1, rest)]
        return np.concatenate([sum(np.bincount(at, share * x, GATES * STEPS) for at, share in parts) for x in (n * sides, n)])

    ones, all_ = _learned(rows, 2 * GATES * STEPS, by_step).reshape(2, -1)
    prior = 1 / (1 + np.exp(-np.tile((np.arange(STEPS) - 16) / 2.0, GATES)))
    refined = _stretch((ones + 20 * prior) / (all_ + 20)).reshape(GATES, STEPS)
    return model._replace(tables=tables, refined=refined.astype(np.float32))


def _weights(rows: DataFrame, model: Model) -> np.ndarray:
    """The weights of least loss, gate by gate; a step that made a gate's loss larger is halved."""
    n_in = TABLES + 1
    cells = 2 + n_in + n_in * n_in
    start = model.weights.astype(float)
    best, weights, least = start, start, np.full(GATES, np.inf)
    move = np.zeros_like(start)
    for _ in range(NEWTON):
        tried = weights

        def slopes(found, level, sides, n):
            numbers, gate = model.inputs(found, level)
            numbers = numbers.astype(float)
            starts = np.flatnonzero(np.concatenate(([True], gate[1:] != gate[:-1]))) if len(gate) else np.zeros(0, int)
            total = np.zeros((GATES, cells))
            away = 1.0 - 2.0 * sides
            for g, a, b in zip(gate[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(gate)]):  # the decisions of a gate are together
                inputs, times = numbers[:, a:b], n[a:b]
                odds = np.exp(np.minimum(tried[g] @ inputs * away[a:b], 700))  # of the side that was not taken
                missed = odds / (1 + odds)
                slope, row = times * missed, total[g]
                row[0] += times.sum()
                row[1] += times @ np.log(1 + odds)
                row[2:2 + n_in] -= inputs @ (slope * away[a:b])
                row[2 + n_in:] += (inputs * (slope * (1 - missed)) @ inputs.T).ravel()
            return total.ravel()

        sums = _learned(rows, GATES * cells, slopes).reshape(GATES, cells)
        loss = sums[:, 1] + HOLD / 2 * ((weights - start) ** 2).sum(1)
        better = loss <= least + GAIN * sums[:, 0]  # sums differ a little from run to run
        best = np.where(better[:, None], weights, best)
        least = np.where(better, loss, least)
        slope, curvature = sums[:, 2:2 + n_in] - HOLD * (weights - start), sums[:, 2 + n_in:].reshape(GATES, n_in, n_in)
        step = np.linalg.solve(curvature + HOLD * np.eye(n_in), slope[..., None])[..., 0]
        move = np.where(better[:, None], step, move / 2)
        weights = best + move
        if (slope * step)[better].sum() <= GAIN * max(sums[:, 0].sum(), 1) and better.all():
            break
    return best


# --- texts to words ---------------------------------------------------------------------------

class Words(NamedTuple):
    """The words of some texts: distinct ones, and in the order of the texts each one's number, text and class before."""

    distinct: pa.Array
    number: np.ndarray
    text: np.ndarray
    before: np.ndarray
    last: np.ndarray  # by text, the class before its end


def words(texts: pa.Array) -> Words:
    whole_ = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())  # a slice of an array is lower-cased wrongly
    low = pc.ascii_lower(whole_)
    del whole_  # what is not needed any more goes, as each of these is as large as the texts
    parts = pc.ascii_split_whitespace(low)
    del low
    flat, text = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    del parts
    full = pc.not_equal(pc.binary_length(flat), 0)
    flat = flat.filter(full)
    told = flat.dictionary_encode()
    del flat
    text = text[full.to_numpy(zero_copy_only=False)]
    number = told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = told.dictionary.cast(pa.large_binary())
    del told, full
    classes, short = np.zeros(len(distinct), np.int64), pc.less_equal(pc.binary_length(distinct), SHORT)
    classes[short.to_numpy(zero_copy_only=False)] = [zlib.crc32(w) % CLASSES + 1 for w in distinct.filter(short).to_pylist()]
    until = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts)))))  # words before each text
    at = np.arange(len(number))
    told = np.maximum.accumulate(np.where(classes[number] > 0, at + 1, 0)) if len(number) else at
    told = np.concatenate(([0], told))  # by how many words have gone by, the last short one, from one
    class_of = np.concatenate(([0], classes[number]))

    def before(gone: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(told[gone] > until[of], class_of[told[gone]], 0)

    return Words(distinct, number, text, before(at, text), before(until[1:], np.arange(len(texts))))


def _told(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys, and the distinct ones in the order of their numbers."""
    told = pa.array(keys).dictionary_encode()
    return told.indices.to_numpy(), told.dictionary.to_numpy()


def beginnings(distinct: pa.Array) -> np.ndarray:
    """The first symbols of words with the blank after them, in 24 bits."""
    data, sizes = ended(distinct)
    starts = np.cumsum(sizes) - sizes
    found = np.zeros(len(sizes), np.int64)
    for k in range(HEAD):
        value = np.where(k < sizes, data[np.minimum(starts + k, max(len(data) - 1, 0))] if len(data) else 0, 0)
        found = found << 8 | value
    return found


def _begin(key: int) -> bytes:
    """The symbols of a beginning; after a blank or an end there is nothing."""
    data = (key & 0xFFFFFF).to_bytes(3, "big")
    return data[:1] if data[0] == END else data[:2] if data[1] == BLANK else data


def _grouped(batches: Iterator[pa.RecordBatch], text: int, together: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many characters."""
    held, size = [], 0
    for batch in batches:
        at = 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            base = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + together - size, "right")))
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1]) - base
            at = end
            if size >= together:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pieces(word: bytes) -> list[bytes]:
    data = word + b" "
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what some texts hold, by kind; a task sums its beginnings before it sends them."""
    held, keys_held = [], 0
    for batch in _grouped(batches, 0, COUNTED):
        w = words(batch.column(0))
        times = np.bincount(w.number, minlength=len(w.distinct))
        short = pc.less(pc.binary_length(w.distinct), PIECE)
        yield _rows(WORD, w.distinct.filter(short), times[short.to_numpy(zero_copy_only=False)])
        begin = beginnings(w.distinct)
        extra = []
        for word, n in zip(w.distinct.filter(pc.invert(short)).to_pylist(), times[~short.to_numpy(zero_copy_only=False)].tolist()):
            pieces = _pieces(word)
            yield _rows(LONG, [hashlib.sha256(word).digest()], [n])
            yield _rows(PART, pieces, [n] * len(pieces))
            extra += [(CONT << 24 | int.from_bytes(p[:3].ljust(3, b"\0"), "big"), n) for p in pieces[1:]]
        of, found = _told(np.concatenate((w.before << 24 | begin[w.number], w.last << 24 | END << 16)))
        held += [(found, np.bincount(of)), tuple(np.array(extra, np.int64).reshape(-1, 2).T)]
        keys_held += len(found) + len(extra)
        if keys_held > KEYS:
            held = [_added(held)]
            keys_held = len(held[0][0])
            if keys_held > KEYS // 2:
                yield _begins(*held[0])
                held, keys_held = [], 0
        yield _rows(STOP, [b""], [batch.num_rows])
    if held:
        yield _begins(*_added(held))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and how often they came, each once."""
    of, keys = _told(np.concatenate([keys for keys, _ in parts]))
    found = np.zeros(len(keys), np.int64)
    np.add.at(found, of, np.concatenate([n for _, n in parts]))
    return keys, found


def _begins(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of beginnings: their numbers in four bytes, the class first."""
    ends = np.arange(0, 4 * len(keys) + 1, 4, dtype=np.int32)
    return _rows(BEGIN, pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(keys.astype(">u4"))]), n)


def _rows(kind: int, entries, n) -> pa.RecordBatch:
    entries = entries.cast(pa.binary()) if isinstance(entries, pa.Array) else pa.array(entries, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(entries), kind), pa.int32()), entries, pa.array(n, pa.int64())],
                                      names=["kind", "entry", "n"])


def lexicon(texts: DataFrame) -> DataFrame:
    """``kind, entry, n``: how often the texts of a one-column table hold each entry."""
    return texts.mapInArrow(freeing(_count), "kind int, entry binary, n long").groupBy("kind", "entry").agg(F.sum("n").alias("n"))


# --- fitting ----------------------------------------------------------------------------------

def _entry_symbols(kinds: np.ndarray, entries: list[bytes]) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Rows of the lexicon as symbols, the class before each, and whether a row counts as a beginning only."""
    data = [e + b" " if k == WORD else e if k == PART else _begin(int.from_bytes(e, "big")) for k, e in zip(kinds.tolist(), entries)]
    classes = np.array([e[0] if k == BEGIN else 0 for k, e in zip(kinds.tolist(), entries)], np.int64)
    s = symbols(np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data], np.int64))
    return s, classes, kinds == BEGIN


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(256)
    for batch in batches:
        kinds, entries, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
        if len(entries):
            s, _, _ = _entry_symbols(kinds, entries)
            found += np.bincount(s.data, n[s.of].astype(float), 256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(found.astype(np.int64))], names=["symbol", "n"])


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of contexts and symbols, by range of the tables; a task sums what it has before it sends it."""
    def sent(held: list[list]) -> Iterator[pa.RecordBatch]:
        for i, parts in enumerate(held):
            if not parts:
                continue
            key, n = (np.concatenate(x) for x in zip(*parts))
            key, n = pack(key >> np.uint64(8), key & np.uint64(255), n)
            most = (1 << 26) - 1
            again = np.maximum(-(-n // most), 1)
            rest = np.repeat(n, again) - most * (np.arange(int(again.sum())) - np.repeat(np.cumsum(again) - again, again))
            key = np.repeat(key, again)
            packed = (key & np.uint64((1 << 38) - 1)) << np.uint64(26) | np.minimum(rest, most).astype(np.uint64)
            ends = np.searchsorted(key >> np.uint64(38), np.arange(SHARDS + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i * SHARDS + full, pa.int32()), pa.array([packed[ends[j]:ends[j + 1]].tobytes() for j in full.tolist()], pa.binary())],
                names=["shard", "packed"])

    held, keys = [[] for _ in range(TABLES)], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            part = batch.slice(start, 20_000)
            s, classes, begins = _entry_symbols(part.column(0).to_numpy(), part.column(1).to_pylist())
            n, of_begin = part.column(2).to_numpy()[s.of], begins[s.of]
            for i, ctx in enumerate(contexts(s, classes)):
                which = of_begin if i == OPENING else ~of_begin
                held[i].append(pack(ctx[which], s.data[which], n[which]))
                keys += len(held[i][-1][0])
            if keys > KEYS:
                held = [[_summed(parts)] if parts else [] for parts in held]
                keys = sum(len(x[0]) for parts in held for x in parts)
                if keys > KEYS // 2:
                    yield from sent(held)
                    held, keys = [[] for _ in range(TABLES)], 0
    yield from sent(held)


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts))
    return pack(key >> np.uint64(8), key & np.uint64(255), n)


class Frequent(NamedTuple):
    """At most ``FREQUENT`` words of under ``PIECE`` bytes, or beginnings: where each stands, how often it came, and what it costs."""

    at: pa.Array
    counts: np.ndarray
    bits: np.ndarray


class Fitted(NamedTuple):
    model: Model
    counts: DataFrame  # kind, entry, n
    tokens: int
    distinct: int
    frequent: Frequent
    begun: Frequent  # beginnings, by their numbers
    received: Callable[[], Model]  # the model, in a worker


def _some(counts: DataFrame, total: int, most: int) -> tuple[int, int]:
    """The least bucket of counts (sixteenths of a power of two) above which there are no more than ``most`` entries."""
    found = counts.groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("rows")).orderBy(F.desc("bucket")).collect()
    n, least = 0, 1 << 20
    for row in found:  # at most 1,024 buckets
        if n + row["rows"] > most:
            break
        n, least = n + row["rows"], row["bucket"]
    return least, n


def _bucket() -> Column:
    return F.floor(16 * F.log2(F.col("n"))).cast("int")


def fit(texts: DataFrame, text_col: str = "text") -> Fitted:
    """Learn from all rows of ``texts``: counts, maps and weights cover all of their entries."""
    counts = stored(lexicon(texts.select(whole(text_col).alias("text"))), "lexicon")
    tokens, distinct = counts.filter(F.col("kind").isin(WORD, LONG, STOP)).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words_ = counts.filter(F.col("kind") == WORD)
    least, _ = _some(words_, 0, FREQUENT)
    spelled = counts.filter(F.col("kind").isin(WORD, PART, BEGIN))
    of_byte = spelled.filter(F.col("kind") != BEGIN).mapInArrow(freeing(_byte_counts), "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    numbers = np.zeros(256, np.int64)
    for row in of_byte.collect():
        numbers[row["symbol"]] = row["n"]
    numbers[END] += counts.filter(F.col("kind") == STOP).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    c = code(numbers)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Range after range of the tables, each from all that tasks have sent for it."""
        shard, parts = None, []

        def done() -> pa.RecordBatch:
            made = places(shard, np.concatenate(parts), c)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made.tobytes()], pa.binary())], names=["shard", "made"])

        for batch in batches:
            for s, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != shard:
                    if parts:
                        yield done()
                    shard, parts = s, []
                parts.append(np.frombuffer(packed.as_buffer(), np.uint64).copy())
        if parts:
            yield done()

    ranges = spelled.mapInArrow(freeing(_context_counts), "shard int, packed binary").repartition("shard").sortWithinPartitions("shard").mapInArrow(
        freeing(build), "shard int, made binary").toArrow()
    tables = [np.zeros(1 << size, np.uint32) for size in PLACES]
    for shard, made in zip(ranges.column("shard").to_pylist(), ranges.column("made")):
        part = np.frombuffer(made.as_buffer(), np.uint32)
        at = shard % SHARDS * len(part)
        tables[shard // SHARDS][at:at + len(part)] = part
    shared = texts.sparkSession.sparkContext.broadcast((tuple(c), tables))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_code, fine = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, DRAWS):
                part = batch.slice(at, DRAWS)
                yield _decided(Code(*of_code), fine, part.column(0).to_numpy(), part.column(1).to_pylist(), part.column(2).to_numpy())

    # Neighbours in order begin alike, so many of their decisions are equal.
    near = spelled.select("kind", "entry", "n").repartitionByRange("kind", "entry").sortWithinPartitions("kind", "entry")
    # Spark reads up to 4,096 rows of a group at once, whatever they hold, so groups are small.
    model = learn(c, tables, stored(near.mapInArrow(freeing(decide), DECIDED), "decisions", **{"parquet.block.size": str(BATCH)}))
    shared.unpersist()
    received = _shipped(texts.sparkSession, model)
    frequent = _costs(words_.filter(_bucket() >= least).select("entry", "n"), lambda entries: word_bits(received(), entries))
    begins = counts.filter(F.col("kind") == BEGIN)
    begun_ = _costs(begins.filter(_bucket() >= _some(begins, 0, FREQUENT)[0]).select("entry", "n"), lambda entries: begin_bits(received(), _numbers(entries)))
    keys = _numbers(begun_.at)
    order = np.argsort(keys)
    begun_ = Frequent(pa.array(keys[order]), begun_.counts[order], begun_.bits[order])
    return Fitted(model, counts, int(tokens), int(distinct), frequent, begun_, received)


def _shipped(spark, model: Model):
    """The model for the workers, as plain arrays: they have no package."""
    sent = spark.sparkContext.broadcast((tuple(model.code), *model[1:]))

    def received() -> Model:
        of_code, *rest = sent.value
        return Model(Code(*of_code), *rest)

    return received


def _numbers(entries: pa.Array) -> np.ndarray:
    """Beginnings as numbers."""
    return np.frombuffer(b"".join(entries.to_pylist()), ">u4").astype(np.int64)


def _costs(table: DataFrame, cost: Callable[[pa.Array], np.ndarray]) -> Frequent:
    """What frequent entries cost, worked out once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = cost(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(bits), pa.list_(pa.float64()))], names=["entry", "n", "bits"])

    found = table.mapInArrow(freeing(work), "entry binary, n long, bits array<double>").toArrow()
    bits = np.array(found.column("bits").combine_chunks().flatten()).reshape(-1, len(CONFIDENCE))
    return Frequent(found.column("entry").combine_chunks().cast(pa.large_binary()), np.array(found.column("n")), bits)


# --- scoring ----------------------------------------------------------------------------------

def word_bits(model: Model, distinct: pa.Array, together: int = 2_000) -> np.ndarray:
    """What the words cost after their beginnings; in order, as words that begin alike share work."""
    order, found = pc.sort_indices(distinct), np.empty((len(distinct), len(CONFIDENCE)))
    for start in range(0, len(distinct), together):
        at = order.slice(start, together)
        s = symbols(*ended(distinct.take(at)))
        found[at.to_numpy()] = model.bits(s, np.zeros(len(at), np.int64), np.flatnonzero(s.at >= HEAD), len(at))
    return found


def begin_bits(model: Model, keys: np.ndarray, together: int = 8_000) -> np.ndarray:
    """What beginnings cost after the class before them."""
    found = [np.zeros((0, len(CONFIDENCE)))]
    for start in range(0, len(keys), together):
        part = keys[start:start + together]
        each = np.stack([part >> 16 & 255, part >> 8 & 255, part & 255], 1).astype(np.uint8)
        sizes = np.where(each[:, 0] == END, 1, np.where(each[:, 1] == BLANK, 2, 3))
        s = symbols(each[np.arange(HEAD) < sizes[:, None]], sizes)
        found.append(model.bits(s, part >> 24, np.arange(len(s.data)), len(part)))
    return np.concatenate(found)


def text_bits(model: Model, w: Words, n: int, of_word: np.ndarray | None = None, begun: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural logarithms of the probabilities of texts, for each degree of confidence and each share of their own words.

    ``of_word`` is what the words cost after their beginnings, ``begun`` some beginnings, sorted, and their costs; what is missing is worked out.
    """
    begin = beginnings(w.distinct)
    where, keys = _told(np.concatenate((w.before << 24 | begin[w.number], w.last << 24 | END << 16)))
    of_word, of_begin = word_bits(model, w.distinct) if of_word is None else of_word, np.empty((len(keys), len(CONFIDENCE)))
    new = np.ones(len(keys), bool)
    if begun is not None and len(begun[0]):
        at = np.minimum(np.searchsorted(begun[0], keys), len(begun[0]) - 1)
        new = begun[0][at] != keys
        of_begin[~new] = begun[1][at[~new]]
    of_begin[new] = begin_bits(model, keys[new])
    ends = of_begin[where[len(w.number):]]
    found = np.empty((n, len(CONFIDENCE) + len(OWN)))
    for k in range(len(CONFIDENCE)):
        each = of_word[:, k].take(w.number) + of_begin[:, k].take(where[:len(w.number)])
        found[:, k] = ends[:, k] + np.bincount(w.text, each, n)
        if k == PLAIN:
            plain = each
    sizes = np.bincount(w.text, minlength=n)
    gone = np.arange(len(w.text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = w.text * max(1, len(w.distinct)) + w.number
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    had = np.empty(len(key))
    had[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(key)]))))
    del key, order, starts
    again = np.flatnonzero(had > 0)
    chance, so_far = np.exp(plain[again]), had[again] / gone[again]  # a first word has none before it
    for k, share in enumerate(OWN, len(CONFIDENCE)):
        each = plain + np.where(gone > 0, np.log1p(-share), 0.0)
        each[again] = np.log((1 - share) * chance + share * so_far)
        found[:, k] = ends[:, PLAIN] + np.where(sizes > 0, np.log1p(-share), 0.0) + np.bincount(w.text, each, n)
    return found


def settled(bits: np.ndarray) -> np.ndarray:
    """Decimal logarithms of the texts' probabilities, the choices mixed by how well each did so far."""
    most = bits.max(1)
    return (most + np.log(np.exp(bits - most[:, None]).mean(1))) / np.log(10)


ROW = ("place long, slot int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double, "
       "kind int, entry binary, hits binary")


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Every text's probability: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``base_score`` is that of single words, (count + 1) / (tokens + distinct + 1) each; the end is a token too. ``held_out``
    is carried along. A null text is empty and has its end only. Rows that repeat an id are scored each. Words and texts of
    any length are scored whole. An empty table gives no row; learned from nothing, all words are alike. Other columns
    are not read.
    """
    spark = docs.sparkSession
    whole_ = fitted.tokens + fitted.distinct + 1
    received = fitted.received
    known = spark.sparkContext.broadcast((tuple(fitted.frequent), (fitted.begun.at.to_numpy(), fitted.begun.bits)))
    stops = _ends(fitted)
    end = float(np.log10((stops + 1) / whole_)), int(stops > 0)
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in ROW.split(", ")]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.nulls(n, kinds[k]) if name not in columns else columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], kinds[k])
            for name, k in fields], names=[name for name, _ in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ((places_, times_, costs), begun), place = received(), known.value, TaskContext.get().partitionId() << 32
        for batch in _grouped(batches, 2, TOGETHER):
            w, n = words(batch.column(2)), batch.num_rows
            released(collect=False)  # the parts of the texts are as large as all that comes after
            at = pc.fill_null(pc.index_in(w.distinct, places_), -1).to_numpy().astype(np.int64)
            rare = at < 0
            terms, of_word = np.zeros(len(at)), np.empty((len(at), len(CONFIDENCE)))
            terms[~rare] = np.log10((times_[at[~rare]] + 1) / whole_)
            of_word[~rare] = costs[at[~rare]]
            of_word[rare] = word_bits(model, w.distinct.filter(pa.array(rare)))
            bits = text_bits(model, w, n, of_word, begun)
            released(collect=False)
            sizes = pc.binary_length(w.distinct).to_numpy(zero_copy_only=False) + 1
            symbols_ = np.bincount(w.text, sizes[w.number].astype(float), n) + 1
            log10 = settled(bits)
            yield batch_of(
                n, place=np.full(n, place), slot=np.arange(n), doc_id=batch.column(0), held_out=batch.column(1),
                n_tokens=np.bincount(w.text, minlength=n) + 1,
                n_known=np.bincount(w.text, (~rare)[w.number], n).astype(np.int64) + end[1],
                base_score=np.bincount(w.text, terms[w.number], n) + end[0], score=log10,
                bits_per_byte=-log10 / np.log10(2) / symbols_)
            here = rare[w.number]
            hit, times = np.unique(w.number[here] * n + w.text[here], return_counts=True)
            if len(hit):
                number = hit // n
                starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
                pairs = np.stack((hit % n, times), 1).astype("<u4").reshape(-1)
                ends = np.concatenate((8 * starts, [8 * len(hit)])).astype(np.int32)
                hits = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
                told = w.distinct.filter(pa.array(rare)).cast(pa.binary())  # each of them has hits, in the same order
                long = pc.greater_equal(pc.binary_length(told), PIECE)
                digests = pa.array([hashlib.sha256(e).digest() for e in told.filter(long).to_pylist()], pa.binary())
                yield batch_of(len(starts), place=np.full(len(starts), place), kind=np.where(long.to_numpy(zero_copy_only=False), LONG, WORD),
                               entry=pc.replace_with_mask(told, long, digests), hits=hits)
            place += 1

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What rare words add to the texts of each place, in which all texts of a place are together."""
        place, sums = None, np.zeros((3, 0))

        def done() -> pa.RecordBatch:
            slots = np.flatnonzero(sums[2])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slots), place), pa.int64()), pa.array(slots, pa.int32()), pa.array(sums[0][slots]), pa.array(sums[1][slots].astype(np.int64))],
                names=["place", "slot", "more_base", "more_known"])

        for batch in batches:
            places_, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hits = batch.column(2)
            sizes = pc.binary_length(hits).to_numpy(zero_copy_only=False) // 8
            pairs = np.frombuffer(b"".join(hits.to_pylist()), "<u4").reshape(-1, 2)
            row = np.repeat(np.arange(len(counts)), sizes)
            terms = np.log10((counts + 1) / whole_)
            starts = np.flatnonzero(np.concatenate(([True], places_[1:] != places_[:-1]))) if len(counts) else []
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for start, stop in zip(starts, [*starts[1:], len(counts)]):
                if places_[start] != place:
                    if sums[2].any():
                        yield done()
                    place, sums = places_[start], np.zeros((3, 0))
                part = slice(ends[start], ends[stop])
                slots, times = pairs[part, 0].astype(np.int64), pairs[part, 1].astype(float)
                n = max(sums.shape[1], int(slots.max()) + 1)
                sums = np.pad(sums, ((0, 0), (0, n - sums.shape[1])))
                for k, weight in enumerate((times * terms[row[part]], times * (counts[row[part]] > 0), times)):
                    sums[k] += np.bincount(slots, weight, n)
        if sums[2].any():
            yield done()

    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), whole(text_col).alias("text")).mapInArrow(freeing(work), ROW), "scores")
    rare = rows.filter("kind is not null").select("place", "kind", "entry", "hits")
    counts = fitted.counts.filter(F.col("kind").isin(WORD, LONG)).hint("merge")
    met = rare.join(counts, ["kind", "entry"], "left").select("place", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "hits")
    more = met.repartition("place").sortWithinPartitions("place").mapInArrow(freeing(folded), "place long, slot int, more_base double, more_known long")
    found = rows.filter("kind is null").join(more, ["place", "slot"], "left")
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(fitted.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score", "bits_per_byte")


def _ends(fitted: Fitted) -> int:
    return fitted.counts.filter(F.col("kind") == STOP).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
