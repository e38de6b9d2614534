"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece of text exactly one token can be the last one of its encoding: the token whose
start is a prefix with a valid last token of its own, such that the two tokens do not merge across their border.
Storing that token for each prefix gives the encoding of all prefixes at once. So bytes are appended without looking
at what is before, and an edit re-encodes from its place until the stored tokens agree again with those before it.

Whether two tokens may stand side by side follows from the order of merges: the tokens at the border grow from single
bytes, in rank order, and the pair is valid if no step of that growth lets the two sides merge first.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marketlake.llm.common import by_place, gathered, joined, kept

#: Pieces and pairs of tokens that a worker remembers; beyond it starts anew. It bounds memory, not results.
REMEMBERED = 150_000

#: Characters that became letters or numbers after Unicode 16, which the merge files' own library
#: follows; the regex package may know newer ones.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 "
    "3D000-3FC3F "
)


class Vocabulary:
    """Tokens by rank, with the validity of their neighbourhoods worked out as needed."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = list(map(len, self.tokens))
        self.longest = max(self.sizes)
        self._edges: dict[tuple[int, bool], list[bytes]] = {}
        self._whole: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """Plain merging of the lowest-ranked pair, leftmost first, down to ``until`` parts; for single tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > until:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min((x for x in ranked if x[0] is not None), default=None)
            if best is None:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if token not in self._whole:
            self._whole[token] = len(self.merged(self.tokens[token])) == 1
        return self._whole[token]

    def _edge(self, token: int, right: bool) -> list[bytes]:
        """The tokens at one end of a token while it grows from bytes, smallest first."""
        if (token, right) not in self._edges:
            data, grown = self.tokens[token], []
            while len(data) > 1:
                grown.append(data)
                data = self.merged(data, until=2)[-1 if right else 0]
            self._edges[token, right] = [data, *reversed(grown)]
        return self._edges[token, right]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.reachable(b) and self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        left, right, never = self._edge(a, True), self._edge(b, False), len(self.tokens)
        i = j = 0
        while True:
            across = self.ranks.get(left[i] + right[j], never)
            grow_left = self.ranks[left[i + 1]] if i + 1 < len(left) else never
            grow_right = self.ranks[right[j + 1]] if j + 1 < len(right) else never
            if across < min(grow_left, grow_right) or across == grow_right < grow_left:
                return False  # of equal ranks the leftmost pair merges first
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece. A piece that is itself a token is that token."""
        rank = self.ranks.get(piece)
        return (rank,) if rank is not None else Prefixes(self, piece).ids()


class Prefixes:
    """A piece of bytes with the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _last(self, end: int) -> int:
        """The one valid last token of a prefix; short ones are tried first."""
        v, data, last = self.vocabulary, self.data, self.last
        ranks, pairs = v.ranks, v.pairs
        for start in range(end - 1, max(0, end - v.longest) - 1, -1):
            token = ranks.get(data[start:end])
            if token is None:
                continue
            if not start:
                if v.reachable(token):
                    return token
                continue
            beside = (last[start], token)
            holds = pairs.get(beside)
            if holds or holds is None and v.neighbours(*beside):
                return token
        raise ValueError("a byte is not in the vocabulary")

    def become(self, data: bytes) -> Prefixes:
        """Other bytes; the prefixes that both have stay."""
        same = 0
        for same, (a, b) in enumerate(zip(self.data, data), 1):
            if a != b:
                same -= 1
                break
        self.data = self.data[:same]
        del self.last[same + 1:]
        return self.append(data[same:])

    def append(self, more: bytes) -> Prefixes:
        """Encode on; what is stored stays as it is."""
        v, last, done = self.vocabulary, self.last, len(self.data)
        self.data = data = self.data + more
        rank_of, known, longest = v.ranks.get, v.pairs.get, v.longest
        for end in range(done + 1, len(data) + 1):  # as in _last, written out: this is the hot loop
            start = end - 1
            while start >= 0 and end - start <= longest:
                token = rank_of(data[start:end])
                if token is not None:
                    if start:
                        holds = known((last[start], token))
                        if holds is None:
                            holds = v.neighbours(last[start], token)
                    else:
                        holds = v.reachable(token)
                    if holds:
                        last.append(token)
                        break
                start -= 1
            else:
                raise ValueError("a byte is not in the vocabulary")
        return self

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of a range of bytes; gives how many prefixes were worked out again.

        A prefix depends on the ``longest`` prefixes before it, so after as many agreements the rest stands.
        """
        old, moved = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start + 1]
        agreed = 0
        for at in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(at))
            beyond = at - start - len(new)
            agreed = agreed + 1 if beyond > 0 and self.last[at] == old[at - moved] else 0
            if agreed >= self.vocabulary.longest and beyond >= self.vocabulary.longest:
                self.last += old[at - moved + 1:]
                return at - start
        return len(self.data) - start

    def ids(self, end: int | None = None) -> tuple[int, ...]:
        """The encoding of a prefix, by default of all."""
        at, found, last, sizes = len(self.data) if end is None else end, [], self.last, self.vocabulary.sizes
        while at:
            found.append(last[at])
            at -= sizes[last[at]]
        return tuple(reversed(found))


class Encoder:
    """Texts to ids: each match of the pattern is a piece of its own."""

    def __init__(self, lines: bytes, pattern: str):
        self.vocabulary = Vocabulary(lines)
        self._pattern = regex.compile(pattern)
        ends = [[int(x, 16) for x in r.split("-")] for r in LATER.split()]
        self._beyond = re.compile(f"[{chr(ends[0][0])}-{chr(0x10FFFF)}]")  # quick to look for, and seldom there
        self._later = re.compile("[" + "".join(f"{chr(e[0])}-{chr(e[-1])}" for e in ends) + "]")
        self._known: dict[str, bytes] = {}  # ids as native 32-bit numbers

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, with later letters and numbers as signs."""
        if text.isascii() or not self._beyond.search(text) or not self._later.search(text):
            return self._pattern.findall(text)
        return [text[m.start():m.end()] for m in self._pattern.finditer(self._later.sub("!", text))]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Pieces not met before, in order, so that each goes on from the prefix it shares with the one before."""
        ranks, prefixes, found = self.vocabulary.ranks, Prefixes(self.vocabulary), [b""] * len(pieces)
        for piece, i in sorted((p.encode(), i) for i, p in enumerate(pieces)):
            rank = ranks.get(piece)
            found[i] = array("i", (rank,) if rank is not None else prefixes.become(piece).ids()).tobytes()
        return found

    def ids(self, text: str) -> list[int]:
        return next(self.ids_of([text])).tolist()

    def ids_of(self, texts: list[str], together: int = 8_000_000) -> Iterator[np.ndarray]:
        """The ids of many texts; those of up to so many characters share the work on new pieces."""
        at = 0
        while at < len(texts):
            parts, n = [], 0
            while at < len(texts) and (not parts or n + len(texts[at]) <= together):
                parts.append(pa.array(self.pieces(texts[at]), pa.large_string()))
                n += len(texts[at])
                at += 1
            yield from joined(pa.concat_arrays(parts), list(map(len, parts)), self._known, self._learn, REMEMBERED)


def _shipped(df: DataFrame, path: str):
    """The vocabulary file for the workers: read once by the driver, a megabyte whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text in ``ids_col`` instead of the text.

    Ids are those of plain rank merging within every match of ``pattern``. A null text is empty and gives no ids, rows that
    repeat are encoded each, and a text of any length is encoded whole. No shuffle; a column that has the name of the result
    is replaced, others may have any name.
    """
    rest = [f for f in docs.schema if f.name not in (text_col, ids_col)]
    shipped = _shipped(docs, ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("bpe", f"encoder {ranks_path} {pattern}", lambda: Encoder(shipped.value, pattern))
        for batch in batches:
            found = list(encoder.ids_of([t or "" for t in batch.column(0).to_pylist()]))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.array([], np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids],
                                             names=[*(f.name for f in rest), ids_col])

    schema = T.StructType([*rest, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return by_place(docs, [text_col, *(f.name for f in rest)]).mapInArrow(work, schema)


def _laid_out(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, where each begins, and its size."""
    sizes = np.array(list(map(len, tokens)), np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col``: the bytes of the ids, which need not be valid text. Null ids give null."""
    rest = [f for f in df.schema if f.name != bytes_col]
    shipped = _shipped(df, ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, sizes = kept("bpe", f"tokens {ranks_path}", lambda: _laid_out(Vocabulary(shipped.value).tokens))
        for batch in batches:
            texts = [None if not ids.is_valid else gathered(flat, starts, sizes, ids.values.to_numpy()).tobytes()
                     for ids in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(texts, pa.binary())],
                                             names=[*(f.name for f in rest), bytes_col])

    return df.mapInArrow(work, T.StructType([*rest, T.StructField(bytes_col, T.BinaryType())]))
