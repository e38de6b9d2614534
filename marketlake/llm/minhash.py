"""Near-duplicates by MinHash: many universal hash minima, banding, verification, components.

Documents with the same set of shingles are one node from the start. A node has 250 minima under hash
functions of the universal family ``x -> (a x + b) mod 2**64``; 50 bands of five minima put it into buckets. Texts at
the similarity of 0.8 share a bucket but for two in a thousand million.

A bucket never becomes all its pairs. First every member is held against the bucket's least node only: pairs whose
signatures agree in fewer than 160 places (six deviations below 0.8) go, the others are confirmed on their
full sets. Components of the links then close most buckets, large ones above all. In what is left, members of
different components that agree by signature meet with their full sets, in parts of bounded size; each part gives
a link only where it joins two components, so a part gives fewer links than it has members. No link is lost: every
pair of a bucket has been confirmed, refused, or connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import freeing, kept, tasks, whole
from marketlake.llm.components import components
from marketlake.session import stored

ROWS, BANDS = 5, 50
MINIMA = ROWS * BANDS
AGREE = 160  # of the minima, for a pair to be confirmed
BLOCK = 4_096  # members of a bucket that meet in one part
ITEMS = 2_000_000  # shingles of a part, 16 MB
WORDS_KEPT = 300_000  # word hashes that a worker remembers
SPREAD = 4_000_000  # ids up to which a set of ids is broadcast, 32 MB; larger sets are joined by shuffle

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct two-word shingles of a text; of a single word, that word."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six blanks of ASCII only
    if not words:
        return np.array([], np.uint64)
    known = kept("minhash", "word hashes", _WordHashes)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) == 1:
        return _mixed(h + np.uint64(1))
    return np.unique(_mixed(h[:-1] * _MIX + _mixed(h[1:])))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_229)
    a = r.integers(0, 2**63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 2**63, MINIMA, np.uint64)


def minima(sets: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, 32 bits each."""
    a, b = kept("minhash", "hash functions", _functions)
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 512):
        np.minimum(least, (sets[at:at + 512, None] * a + b).min(axis=0), out=least)
    return least >> np.uint64(32)


def bands(least: np.ndarray) -> np.ndarray:
    """A bucket for each band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ column) * _MIX
    return key


SKETCH = "doc_id long, node long, n_shingles long, witness long, signature binary, buckets array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text as a node, its signature of eight bits for each minimum, and its buckets."""
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            items = shingles(text.as_py())
            if len(items):
                least = minima(items)
                node = int.from_bytes(xxhash.xxh3_64_digest(items.tobytes()), "big", signed=True)
                rows.append((node, len(items), least.astype(np.uint8).tobytes(), bands(least).view(np.int64)))
            else:
                rows.append((None, 0, None, None))
        node, n, signature, buckets = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), batch.column("witness"),
             pa.array(signature, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
            names=["doc_id", "node", "n_shingles", "witness", "signature", "buckets"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("su", "sv"))
        good = pa.array((x == y).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(good)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the Jaccard similarity of their full sets at 0.8 or more, in whole numbers."""
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("iu"), batch.column("iv")):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            linked.append(100 * common >= 80 * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())],
                                         names=["u", "v", "linked"])


def _parts(batches: Iterator[pa.RecordBatch], work, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key, part`` go to ``work`` one part at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        of = np.stack([table["key"].to_numpy(), table["part"].to_numpy()], 1)
        starts = np.concatenate(([0], np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1))
        held = table.slice(starts[-1])
        rows = [r for a, b in zip(starts[:-1], starts[1:]) for r in work(table.slice(a, b - a))]
        yield pa.RecordBatch.from_pylist(rows, schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist(list(work(held)), schema)


def _meetings(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """For members outside the largest component of a part: members of other components that agree by signature.

    Best first. In a part made of two blocks only pairs across them count.
    """
    labels, sides = rows["label"].to_numpy(), rows["side"].to_numpy()
    kinds, counts = np.unique(labels, return_counts=True)
    if len(kinds) < 2:
        return
    signatures = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(-1, MINIMA)
    across = sides.min() != sides.max()
    for i in np.flatnonzero(labels != kinds[counts.argmax()]):
        other = labels != labels[i]
        if across:
            other &= sides != sides[i]
        at = np.flatnonzero(other)
        agree = (signatures[at] == signatures[i]).sum(axis=1)
        best = np.argsort(-agree, kind="stable")
        yield i, at[best[:(agree >= AGREE).sum()]]


OPEN = "key long, part long, side long, node long, label long"


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a part that agree with a member of another component."""
    names = ["key", "part", "side", "node", "label"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def work(rows):
        alive = np.zeros(rows.num_rows, bool)
        for i, at in _meetings(rows):
            alive[at] = True
            alive[i] |= len(at) > 0
        return rows.select(names).filter(pa.array(alive)).to_pylist()

    return _parts(batches, work, schema)


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links on the full sets that join components within a part."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(rows):
        nodes, items = rows["node"].to_numpy(), rows["items"]
        labels = rows["label"].to_numpy()
        values, offsets = items.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(items.value_lengths().to_numpy())))
        buckets = rows["buckets"].flatten().to_numpy().reshape(-1, BANDS)
        here = int(np.flatnonzero(buckets[0] == rows["key"][0].as_py())[0])
        root = {int(x): int(x) for x in labels}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, at in _meetings(rows):
            # A pair is looked at in the first bucket it shares.
            at = at[~(buckets[at, :here] == buckets[i, :here]).any(axis=1)]
            own = values[offsets[i]:offsets[i + 1]]
            for some in np.split(at, range(32, len(at), 32)):
                me = find(int(labels[i]))
                some = [j for j in some if find(int(labels[j])) != me]
                if not some:
                    continue
                theirs = [values[offsets[j]:offsets[j + 1]] for j in some]
                sizes = np.array([len(t) for t in theirs])
                flat = np.concatenate(theirs)
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                common = np.add.reduceat((own[place] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
                for j in np.array(some)[100 * common >= 80 * (len(own) + sizes - common)]:
                    a, b = find(int(labels[i])), find(int(labels[j]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        yield {"u": int(nodes[i]), "v": int(nodes[j])}

    return _parts(batches, work, schema)


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, items``: the sets of some nodes, read from a text of each."""
    wanted = stored(wanted.distinct().join(nodes, "node"), "wanted")
    some = F.broadcast(wanted) if wanted.count() <= SPREAD else wanted
    texts = docs.join(some, docs.doc_id.eqNullSafe(some.at) & (docs.witness == some.seen))
    found = texts.select("node", "text").mapInArrow(freeing(_sets), "node long, items array<long>")
    return stored(found.dropDuplicates(["node"]), "sets")  # a repeated row gives its set twice


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, dealt into parts of bounded size.

    Members of a bucket's largest component are connected among themselves already, so only pairs with an outsider count.
    Both kinds are cut into blocks of their own, sides 2 i for outsiders, 2 i + 1 for the others, and a part is two blocks of
    outsiders or one of each. A member of the largest component is copied once for each block of outsiders, an outsider once for
    each block of either kind.
    """
    now = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    now = stored(now.join(mixed.select("key"), "key"), "mixed")
    sizes = now.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items"))
    totals = sizes.groupBy("key").agg(F.max(F.struct("n", "label", "items")).alias("most"), F.sum("n").alias("n"),
                                      F.sum("items").alias("items"), F.count("*").alias("kinds"))

    def blocks(n: Column, items: Column) -> Column:
        return F.ceil(F.greatest(n * 2 / BLOCK, items * 2 / ITEMS)).cast("long")

    outside, inside = (F.col("n") - F.col("most.n"), F.col("items") - F.col("most.items")), (F.col("most.n"), F.col("most.items"))
    several = totals.select("key", "kinds", F.col("most.label").alias("main"), blocks(*outside).alias("outer"), blocks(*inside).alias("inner"))
    dealt = now.join(several, "key").withColumn("outside", F.col("label") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner")))
    dealt = dealt.withColumn("side", 2 * own + F.when(F.col("outside"), 0).otherwise(1))

    def up_to(n: Column, odd: int) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: 2 * i + odd)

    outer, inner = up_to(F.col("outer"), 0), up_to(F.col("inner"), 1)
    both = F.when(F.col("kinds") > 2, F.concat(outer, inner)).otherwise(inner)  # outsiders of one component are connected too
    others = F.when(F.col("outside"), both).otherwise(outer)
    dealt = dealt.withColumn("other", F.explode(others))
    part = F.least("side", "other") * 2 * F.greatest("outer", "inner") + F.greatest("side", "other")
    return dealt.select("key", part.alias("part"), "side", "node", "label")


def _labels(docs: DataFrame, nodes: DataFrame, sketches: DataFrame) -> DataFrame:
    """``node, label`` of the linked nodes but the least of each component."""
    n, signatures = max(2, tasks(docs.sparkSession)), sketches.select("node", "signature")
    keys = sketches.select("node", "n_shingles", F.explode("buckets").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(keys.join(buckets.select("key", "hub"), "key"), "shared")
    pairs = shared.filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    pairs = (pairs.join(signatures.select(F.col("node").alias("u"), F.col("signature").alias("su")), "u")
             .join(signatures.select(F.col("node").alias("v"), F.col("signature").alias("sv")), "v"))
    pairs = stored(pairs.select("u", "v", "su", "sv").mapInArrow(freeing(_likely), "u long, v long"), "pairs")
    sets = _sets_of(docs, nodes, pairs.select(F.col("u").alias("node")).union(pairs.select("v")))
    held = (pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("iu")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("items").alias("iv")), "v"))
    labels = components(held.select("u", "v", "iu", "iv").mapInArrow(freeing(_confirm), "u long, v long, linked boolean").filter("linked"))

    def by_part(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "key", "part").sortWithinPartitions("key", "part", "node")

    dealt = _open(shared, labels).join(signatures, "node").select(*OPEN.replace(" long", "").split(", "), "signature")
    alive = stored(by_part(dealt).mapInArrow(freeing(_alive), OPEN), "alive")
    fresh = alive.select("node").join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(_sets_of(docs, nodes, fresh))
    meeting = alive.join(sketches.select("node", "signature", "buckets"), "node").join(sets, "node")
    joined = by_part(meeting.select("key", "part", "side", "node", "label", "signature", "buckets", "items"))
    joined = joined.mapInArrow(freeing(_joining), "u long, v long")
    edges = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
    return components(edges.unionByName(joined))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.8 or more between sets of two-word shingles.

    One row per input row: ``doc_id, n_shingles, component_id, kept``. ``component_id`` is the smallest id reachable;
    ``kept`` says that it is the row's own. Null ids come last; rows that repeat an id and a text say the same. Texts
    without words, null ones too, have no shingles and are linked with nothing. Other columns are not read.
    """
    return _classes(docs, id_col, text_col).drop("witness")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`near_duplicates` that are kept, as the documents they are."""
    gone = stored(_classes(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("witness").alias("_seen")).distinct(), "gone")
    some = F.broadcast(gone) if gone.count() <= SPREAD else gone
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(whole(text_col)).alias("seen"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("seen") == F.col("_seen"))
    return own.join(some, same, "left_anti").select("row.*")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    docs = docs.withColumn("witness", F.xxhash64("text"))
    sketches = stored(docs.mapInArrow(freeing(_sketch), SKETCH), "sketches")
    members = sketches.select("doc_id", "node", "n_shingles", "witness")
    # One text of each node, by its id and a hash, for repeated ids.
    first = F.min(F.struct(F.col("doc_id").alias("at"), F.col("witness").alias("seen"))).alias("first")
    of_node = sketches.filter("node is not null").groupBy("node").agg(
        first, F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    of_node = stored(of_node.select("node", "first.*", "least", "copies"), "nodes")
    one = sketches.filter("node is not null").select("node", "n_shingles", "signature", "buckets").dropDuplicates(["node"])
    labels = _labels(docs, of_node.select("node", "at", "seen"), stored(one, "signatures"))
    labelled = of_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = stored(labelled.join(least, "label").select("node", "component_id", "copies"), "placed")
    # Sets held by a thousandth of the documents or more, a thousand at most, are joined by broadcast.
    large = placed.filter(F.col("copies") >= max(1_000, members.count() // 1_000)).select("node", "component_id")
    rest = members.filter("node is not null").join(F.broadcast(large.select("node")), "node", "left_anti")
    found = (members.join(F.broadcast(large), "node")
             .unionByName(rest.join(placed.select("node", "component_id"), "node"))
             .unionByName(members.filter("node is null").withColumn("component_id", F.col("doc_id"))))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "witness")
