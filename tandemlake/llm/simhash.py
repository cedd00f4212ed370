"""SimHash near-duplicate classes, with BK-trees over shards of the fingerprints.

Fingerprints that differ in at most RADIUS bits agree in all but RADIUS of any blocks of bits, so every link lies within
a shard of fingerprints with equal bits in some choice of blocks. A shard becomes a BK-tree: children hang at their integer
Hamming distance to the parent, and a search follows only edges within the radius of the distance to the node. Trees
are bounded: a shard above TREE_SIZE fingerprints is dealt to several trees, and each of its parts is searched in the
tree of every other part. Trees travel with their shard's queries, as shards grow with the corpus and a broadcast of
them would have no bound. Of a shard's links only those that join two classes leave the task; the classes of the whole
corpus are the connected components of these.

`near_classes` links 64-bit fingerprints within RADIUS bits. `similar_rows` links texts by the exact Jaccard similarity
of their sets of shingles: the trees give the first candidates, from fingerprints of the sets, and what fingerprints
miss comes from shared first shingles: in any one order of all shingles, two sets of n and m shingles with a similarity
of s share one of their first n - ceil(s n) + 1 and m - ceil(s m) + 1 shingles. All candidates are compared shingle by
shingle, so no pair is lost and none is added.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import bound_batches, cut, discard, give_back, map_columns, read_table, release, whole_text
from .graph import components

RADIUS = 3
BITS = 64
SHINGLE = 3
SEED = 42
#: Fingerprints of a tree at most.
TREE_SIZE = 16_384
#: From so many fingerprints on, queries go down the tree together, in numpy.
TOGETHER = 48
_CHUNK = 65_536
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Texts, about, and at most one in so many, whose shingles are counted to put common ones last, and common shingles at
#: most. Results don't depend on it: any order is right.
SAMPLE_TEXTS = 20_000
SAMPLE_STEP = 8
COMMON = 1 << 18
#: A node's number: the size of its set, as far as SIZE_BITS go, before a running number of NODE_BITS.
NODE_BITS = 39
SIZE_BITS = 24
#: Shingles of a set for each counter of its outline, at least.
OUTLINE_STEP = 2
#: Rows of a large group of a first shingle that meet in one task, of each side.
GROUP_ROWS = 4_096
#: Counters of a set's sketch, and nodes of other classes that a node is compared with before all are.
SKETCH = 64
NEAREST = 8
#: Bytes of the sets of a block of nodes, about, whose pairs with another block are compared in one task; least blocks.
CELL_BYTES = 8 << 20
LEAST_BLOCKS = 4
#: Pairs of an Arrow batch, about; bits of the map of wanted rows at most.
_PAIRS = 200_000
WANTED_BITS = 1 << 26


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, one where more than half the shingles' XXH64 have it set; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return digest(join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        m = min(_CHUNK, n - at)
        hashes = np.fromiter((digest(join(words[i : i + shingle]), SEED) for i in range(at, at + m)), np.uint64, m)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(m, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (the 64 bits as a signed bigint) of every whole text; null texts count as empty."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        fps = [fingerprint(t, shingle) for t in rows["_text"]]
        return {key: rows[key], "fp": [f - (1 << BITS) if f >> (BITS - 1) else f for f in fps]}

    typed = df.schema[key].dataType.simpleString()
    return map_columns(df.select(key, whole_text(text).alias("_text")), f"`{key}` {typed}, fp bigint", work)


class BKTree:
    """Fingerprints by Hamming distance to their parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while at < new:
            d = (value ^ self.values[at]).bit_count()
            nearer = self.children[at].get(d)
            if nearer is None:
                self.children[at][d] = new
                return
            at = nearer

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at most `radius` away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found

    def within_all(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place, indices of the queries at most `radius` away from its value); all queries go down together.

        values: a row of 64-bit words for each query, the highest first.
        """
        todo = [(0, np.arange(len(values)))] if self.values else []
        while todo:
            at, who = todo.pop()
            d = np.bitwise_count(values[who] ^ as_words([self.values[at]], values.shape[1])).sum(axis=1, dtype=np.int16)
            near = who[d <= radius]
            if len(near):
                yield at, near
            for edge, child in self.children[at].items():
                some = who[np.abs(d - edge) <= radius]
                if len(some):
                    todo.append((child, some))


def as_words(values: list[int], width: int) -> np.ndarray:
    """Numbers as rows of `width` 64-bit words."""
    return np.frombuffer(b"".join([v.to_bytes(8 * width, "big") for v in values]), ">u8").astype(np.uint64).reshape(-1, width)


def tree_links(tree_ids: list[int], tree_fps: list[int], ids: list[int], fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between ids with fingerprints within the radius, as many as needed to connect what all links connect.

    The first two lists fill the tree, the others are the queries; the same lists may be given twice.
    """
    tree = BKTree()
    for f in tree_fps:
        tree.add(f)
    every = {i: n for n, i in enumerate(dict.fromkeys([*tree_ids, *ids]))}
    names = list(every)
    root = np.arange(len(names))

    def top(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = up

    links = []
    places = np.array([every[i] for i in tree_ids])
    queries = np.array([every[i] for i in ids])
    if len(fps) < TOGETHER:
        hits = ((p, np.array([q])) for q, f in enumerate(fps) for p in tree.within(f, radius))
    else:
        width = -(-max(max(fps).bit_length(), max(tree_fps).bit_length(), 1) // BITS)
        hits = tree.within_all(as_words(fps, width), radius)
    for p, who in hits:
        if len(who) == 1 and queries[who[0]] == places[p]:
            continue
        tops = np.unique(top(np.append(queries[who], places[p])))
        if len(tops) > 1:
            root[tops] = tops[0]
            links += [(names[t], names[tops[0]]) for t in tops[1:].tolist()]
    return links


def _searcher(radius: int, number: Callable) -> Callable:
    """Search of sorted shards; `number` makes an unsigned number of a fingerprint."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard's rows may span batches."""
        shard, rows = None, ([], [], [])
        out_a: list[int] = []
        out_b: list[int] = []

        def close():
            ids, fps, roles = rows
            if len(ids) > 1:
                if 1 in roles or 2 in roles:
                    tree = [i for i, r in enumerate(roles) if r == 1]
                    query = [i for i, r in enumerate(roles) if r == 2]
                else:
                    tree = query = range(len(ids))
                if tree and query:
                    numbers = [number(f) for f in fps]
                    for a, b in tree_links([ids[i] for i in tree], [numbers[i] for i in tree], [ids[i] for i in query], [numbers[i] for i in query], radius):
                        out_a.append(a)
                        out_b.append(b)

        for batch in batches:
            got = batch.to_pydict()
            for key, node, fp, role in zip(zip(got["block"], got["bits"], got["part"], got["other"]), got["node"], got["fp"], got["role"]):
                if key != shard:
                    close()
                    shard, rows = key, ([], [], [])
                rows[0].append(node)
                rows[1].append(fp)
                rows[2].append(role)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
            out_a, out_b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
        give_back()

    return search


def _unsigned(fp: int) -> int:
    return fp % (1 << BITS)


def shard_links(shards: DataFrame, radius: int, number: Callable) -> DataFrame:
    """a, b: links that connect what all links within the radius connect, of those within a shard.

    shards: node bigint, fp, block int, bits (equal within a shard of a block).
    """
    ship(shards.sparkSession)
    bound_batches(shards.sparkSession)
    large = shards.groupBy("block", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > TREE_SIZE)
    dealt = shards.join(large, ["block", "bits"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / TREE_SIZE), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # A part meets itself, is the tree for later parts and is searched in earlier parts' trees.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(
            F.least(own, o).alias("part"), F.greatest(own, o).alias("other"), F.when(o > own, 1).when(o < own, 2).otherwise(0).alias("role")
        ),
    )
    rows = dealt.select("node", "fp", "block", "bits", F.explode(meets).alias("meet")).select("node", "fp", "block", "bits", "meet.*")
    sorted_rows = rows.repartition("block", "bits", "part", "other").sortWithinPartitions("block", "bits", "part", "other", "fp")
    return sorted_rows.mapInArrow(_searcher(radius, number), "a bigint, b bigint")


def shard_plan(n: int) -> tuple[int, tuple[tuple[int, ...], ...]]:
    """(blocks, choices): fingerprints are cut into blocks, and those of a choice of blocks equal make a shard.

    RADIUS differing bits leave all but RADIUS of the blocks equal, so every link lies within a shard of some choice. The
    more blocks, the more of the bits a shard fixes: the least number is taken whose shards have at most TREE_SIZE of n
    evenly spread fingerprints, so work grows in proportion to n.
    """
    for blocks in range(RADIUS + 1, 2 * RADIUS + 2):
        if n <= TREE_SIZE << (BITS * (blocks - RADIUS) // blocks):
            break
    return blocks, tuple(combinations(range(blocks), blocks - RADIUS))


def near_links(nodes: DataFrame) -> DataFrame:
    """a, b: links that connect what all links within RADIUS connect. nodes: node bigint, distinct fp bigint."""
    blocks, choices = shard_plan(nodes.count())
    cuts = [BITS * i // blocks for i in range(blocks + 1)]

    def bits(choice: tuple[int, ...]) -> Column:
        """The bits of the chosen blocks; the others are zero."""
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in choice)
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))

    keys = F.array(*[F.struct(F.lit(i).alias("block"), bits(c).alias("bits")) for i, c in enumerate(choices)])
    shards = nodes.select("node", "fp", F.explode(keys).alias("key")).select("node", "fp", "key.*")
    return shard_links(shards, RADIUS, _unsigned)


def shingle_hashes(text: str, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """XXH64 of the distinct shingles, sorted; of all words where they are fewer, and none without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def first_shingles(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Those of which similar sets share one: the first n - ceil(similarity n) + 1, rare ones before the sorted common."""
    seen = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, counts[at], 0)
    n = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, seen))[:n]]


def _common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that recur in a sample of the texts."""
    step = max(SAMPLE_STEP, texts.count() // SAMPLE_TEXTS)
    some = texts.select("_text").filter(F.pmod(F.xxhash64("_text"), F.lit(step)) == 0)
    found = map_columns(some, "h array<bigint>", lambda rows: {"h": [shingle_hashes(t, shingle).view(np.int64) for t in rows["_text"]]})
    counted = cut(found.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    # The most frequent ones, as many of equal counts as stay within COMMON.
    least, total = 2, 0
    for n, c in sorted(((r["n"], r["c"]) for r in counted.groupBy("n").agg(F.count("*").alias("c")).collect()), reverse=True):  # a row a count
        total += c
        if total > COMMON:
            least = n + 1
            break
    got = counted.filter(F.col("n") >= least).toArrow()  # at most COMMON rows
    hashes, counts = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is one where over half of the hashes have it set; 0 without any. Signed."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def outline(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall to each of some buckets, by their low bits: a byte each, at most 255."""
    buckets = 1 << max(3, (len(hashes) // OUTLINE_STEP).bit_length() - 1)
    counts = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall to each of SKETCH buckets, modulo 256."""
    return np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8).tobytes()


def sketch_distances(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """About the number of hashes that each set of `others` (rows of counters) has not in common with `own`: squares of the
    counters' differences, right below 128."""
    apart = (others - own).view(np.int8).astype(np.int32)
    return (apart * apart).sum(axis=1)


def may_be_alike(n: int, x: bytes, m: int, y: bytes, similarity: float) -> bool:
    """Whether outlines of sets of n and m shingles allow the similarity: they share at most the lesser counts."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if a.max(initial=0) == 255 or b.max(initial=0) == 255:
        return True
    size = min(len(a), len(b))
    a, b = (v if len(v) == size else v.reshape(-1, size).sum(axis=0, dtype=np.int64) for v in (a, b))
    both = int(np.minimum(a, b).sum(dtype=np.int64))
    return both + 1e-9 >= similarity * (n + m - both)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, node, pos), sorted, those of first shingles that several nodes have.

    The first and the last row of a partition stay anyhow, as a group may go on in the next one.
    """
    held: list[np.ndarray] = []  # the last row, which waits for what follows
    held_stays = True
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(3)]
        if held:
            columns = [np.append(x, y) for x, y in zip(held, columns)]
        same = columns[0][1:] == columns[0][:-1]
        keep = np.append(held_stays, same) | np.append(same, False)
        held_stays = bool(same[-1]) if len(same) else held_stays
        held = [c[-1:] for c in columns]
        out = np.flatnonzero(keep[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in columns], names=["h", "node", "pos"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["h", "node", "pos"])
    give_back()


def node_size(node):
    return node >> NODE_BITS


def _fits(similarity: float, node: np.ndarray, pos: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether sets may be alike whose first common shingle in the order stands at these positions.

    Both must have room for all that they would share from there on.
    """
    n, m = node_size(node), node_size(other)
    least = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-6)
    room = [np.where(size == (1 << SIZE_BITS) - 1, np.inf, size - place) for size, place in ((n, pos), (m, at))]
    return (room[0] >= least) & (room[1] >= least) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)


def _neighbours(similarity: float, steps: int) -> Callable:
    """Pairs of nodes at most `steps` rows apart within a group, of different classes, that may be alike.

    Rows (h, node, pos, label) come sorted by h.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(4)]
            old = len(held[0]) if held else 0
            if held:
                columns = [np.append(x, y) for x, y in zip(held, columns)]
            h, node, pos, label = columns
            a, b = [], []
            for step in range(1, steps + 1):
                i = np.flatnonzero((h[step:] == h[:-step]) & (label[step:] != label[:-step])) if len(h) > step else np.empty(0, int)
                i = i[i + step >= old]  # pairs of held rows are known
                i = i[_fits(similarity, node[i], pos[i], node[i + step], pos[i + step])]
                a.append(np.maximum(node[i], node[i + step]))
                b.append(np.minimum(node[i], node[i + step]))
            held = [c[-steps:] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])
        give_back()

    return work


def _crossing(similarity: float, nearest: int | None = None) -> Callable:
    """Pairs of nodes of different classes that may be alike, one of them being of role 1.

    Rows (cell, role, node, pos, label) come sorted by cell; role 0 are a block of a group's nodes, role 1 those that
    aren't of the group's main class. A cell has at most GROUP_ROWS rows of each role, or so. nearest: a node of role 1
    makes at most so many pairs in a cell, with those whose sketches, a sixth column, are nearest to its own.
    """

    def pairs(rows: list[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        role, node, pos, label, *more = (np.concatenate(x) for x in zip(*rows))
        left = role == 0
        order = np.argsort(node[left])
        every, places, labels = (x[left][order] for x in (node, pos, label))
        sizes = node_size(every)
        if nearest is not None:
            counters = np.frombuffer(b"".join(more[0].tolist()), np.uint8).reshape(len(role), -1)
            drawn, mine = counters[left][order], iter(counters[~left])
        for x, at, own in zip(*(v[~left].tolist() for v in (node, pos, label))):
            n = node_size(x)
            part = slice(np.searchsorted(sizes, n * similarity - 1e-6), np.searchsorted(sizes, n / similarity + 1e-6, "right"))
            ok = labels[part] != own
            other, place = every[part][ok], places[part][ok]
            fit = _fits(similarity, np.full(len(other), x), np.full(len(other), at), other, place)
            other = other[fit]
            if nearest is not None:
                counts = next(mine)
                if len(other) > nearest:
                    other = other[np.argpartition(sketch_distances(counts, drawn[part][ok][fit]), nearest)[:nearest]]
            if len(other):
                yield np.maximum(other, x), np.minimum(other, x)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
        """The rows of one cell after the other; a cell may span batches."""
        cell, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            starts = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1])).tolist()
            for begin, end in zip(starts, [*starts[1:], len(columns[0])]):
                if columns[0][begin] != cell and rows:
                    yield rows
                    rows = []
                cell = columns[0][begin]
                rows.append([c[begin:end] for c in columns[1:]])
        if rows:
            yield rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for rows in cells(batches):
            for pair in pairs(rows):
                out.append(pair)
                held += len(pair[0])
                if held >= _PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])
        give_back()

    return work


def _alike(similarity: float) -> Callable:
    """The pairs that are similar: rows (cell, role, a, b, x) come sorted by cell and role, first the sets x of nodes a
    (role 0), then the pairs (role 1). A set is there once for all pairs of its cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for at, role, a, b, x in zip(*(c.to_pylist() for c in batch.columns)):
                if at != cell:
                    cell, sets = at, {}
                if role == 0:
                    sets[a] = np.frombuffer(x, np.uint64)
                    continue
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both + 1e-9 >= similarity * (len(x) + len(y) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])
        give_back()

    return work


def _allowed(similarity: float) -> Callable:
    def work(rows: dict[str, list]) -> dict[str, list]:
        ok = [may_be_alike(*r, similarity) for r in zip(rows["n"], rows["x"], rows["m"], rows["y"])]
        return {k: [v for v, good in zip(rows[k], ok) if good] for k in ("a", "b")}

    return work


def row_name(key: str = "doc_id", digest: str = "digest") -> Column:
    """SHA-256 of a row's key and digest: rows of equal key and text are one."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary"), F.col(digest)), 256))


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(whole_text(text), 256))


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(bits))


def _wanted_bits(rows: DataFrame, bits: int) -> np.ndarray:
    """One byte for each 8 places, with the bits of the wanted rows."""
    part = 32_768
    at = rows.select(_place(bits).alias("p")).groupBy((F.col("p") / part).cast("long").alias("k")).agg(F.bitmap_construct_agg(F.col("p") % part).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in at.collect():  # at most bits / 32,768 rows of 4 KB
        out[r["k"] * part // 8 : (r["k"] + 1) * part // 8] = np.frombuffer(r["m"], np.uint8)
    return out


def _numbered_sets(prints: DataFrame, key: str) -> DataFrame:
    """name, row, node: a number for each distinct set, which begins with its size, and one row that has the set."""
    one = prints.groupBy("name").agg(F.min(row_name(key)).alias("row"), F.first("n").alias("n"))
    one = cut(one.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = one.groupBy(part).agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))  # a row a partition
    number = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")
    size = F.shiftleft(F.least("n", F.lit((1 << SIZE_BITS) - 1)), NODE_BITS)
    return cut(one.withColumn("part", part).join(F.broadcast(starts), "part").select("name", "row", "n", (size + number).alias("node")))


def _cells(labelled: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """cell, role, node, pos, label: the nodes of each first shingle that several classes share, ready to be compared.

    The main class of a shingle is its most frequent one; its nodes meet only the others. Groups of any size are dealt
    to cells of bounded size: a block of the group's nodes, and a block of those of other classes. With sketches (node,
    sketch) only groups of more than NEAREST nodes, and the sketch of each.
    """
    per = labelled.groupBy("h", "label").agg(F.count("*").alias("c"))
    groups = per.groupBy("h").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("g")).filter("g > main.c")
    blocks = lambda c: F.ceil(c / GROUP_ROWS).cast("int")
    groups = groups.select("h", "g", F.col("main.label").alias("main"), blocks(F.col("g")).alias("p"), blocks(F.col("g") - F.col("main.c")).alias("q"))
    kept = ["h", "node", "pos", "label"]
    if sketches is not None:
        groups = groups.filter(F.col("g") > NEAREST)
    rows = labelled.join(groups.drop("g"), "h")
    if sketches is not None:
        rows, kept = rows.join(sketches, "node"), [*kept, "sketch"]
    place = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    count = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    own = F.transform(count("q"), lambda j: F.struct(F.lit(0).alias("role"), place("p").alias("i"), j.alias("j")))
    others = F.transform(count("p"), lambda i: F.struct(F.lit(1).alias("role"), i.alias("i"), place("q").alias("j")))
    none = F.array().cast("array<struct<role:int,i:int,j:int>>")
    meets = F.concat(own, F.when(F.col("label") != F.col("main"), others).otherwise(none))
    met = rows.select(*kept, F.explode(meets).alias("m")).repartition("h", "m.i", "m.j").sortWithinPartitions("h", "m.i", "m.j")
    return met.select(F.xxhash64("h", "m.i", "m.j").alias("cell"), F.col("m.role").cast("bigint").alias("role"), *kept[1:])


def similar_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """key, digest (SHA-256 of the text), class of every row; rows of a class are those reachable over links.

    Texts link where the Jaccard similarity of their sets of `shingle`-word shingles (words as in `fingerprint`) is at
    least `similarity`, exactly. Texts without words (null, empty, blank) link to each other. Keys, null or repeated,
    have no part in it.

    Candidates come in rounds. First: sets whose fingerprints the trees find within RADIUS bits, and of those that share
    a first shingle, or a fingerprint, neighbours in a random order, a different one for each shingle. Then, as far as
    classes differ, each set outside the main class of a first shingle with the NEAREST whose sketches are most like its
    own. These join nearly all that is alike, by pairs in proportion to the rows. Last: of those that share a first
    shingle all pairs whose classes still differ. Outlines rule out most candidates before any set is fetched.
    """
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    texts = df.select(key, whole_text(text).alias("_text")).withColumn("digest", text_digest("_text"))
    common, counts = _common_shingles(texts, shingle)

    def work(rows: dict[str, list]) -> dict[str, list]:
        sets = [shingle_hashes(t, shingle) for t in rows["_text"]]
        return {
            key: rows[key], "digest": rows["digest"], "name": [hashlib.sha256(x.tobytes()).digest()[:16] for x in sets], "n": [len(x) for x in sets],
            "fp": [set_fingerprint(x) for x in sets], "outline": [outline(x) for x in sets], "sketch": [sketch(x) for x in sets],
            "first": [first_shingles(x, common, counts, similarity).view(np.int64) for x in sets],
        }

    typed = df.schema[key].dataType.simpleString()
    prints = cut(map_columns(texts, f"`{key}` {typed}, digest binary, name binary, n bigint, fp bigint, outline binary, sketch binary, first array<bigint>", work))
    # One node for each distinct set: copies are never compared with each other.
    nodes = _numbered_sets(prints, key)
    own = lambda *columns: prints.select("name", row_name(key).alias("row"), *columns).join(nodes.select("name", "row", "node"), ["name", "row"]).dropDuplicates(["name", "row", "node"]).select("node", *columns)

    firsts = own("first").select(F.posexplode("first").alias("pos", "h"), "node").select("h", "node", F.col("pos").cast("bigint").alias("pos"))
    # Ranges of both columns, so a frequent shingle is spread over many tasks.
    shared = cut(firsts.repartitionByRange("h", "node").sortWithinPartitions("h", "node").mapInArrow(_shared, "h bigint, node bigint, pos bigint"))
    outlines = cut(own("n", "fp", "outline", "sketch"))

    def neighbours(rows: DataFrame) -> DataFrame:
        mixed = rows.withColumn("mix", F.xxhash64("h", "node", F.lit(1))).repartitionByRange("h", "mix").sortWithinPartitions("h", "mix")
        return mixed.select("h", "node", "pos", "label").mapInArrow(_neighbours(similarity, 1), "a bigint, b bigint")

    def classed(found: DataFrame) -> DataFrame:
        """The shared first shingles with the class of each node by the links found."""
        return cut(shared.join(components(found), "node", "left").select("h", "node", "pos", F.coalesce("component", "node").alias("label")))

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar: outlines first, then the sets of those that remain."""
        x = outlines.select(F.col("node").alias("a"), "n", F.col("outline").alias("x"))
        y = outlines.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("outline").alias("y"))
        left = cut(map_columns(pairs.join(x, "a").join(y, "b"), "a bigint, b bigint", _allowed(similarity)))
        ends = left.select(F.col("a").alias("node")).distinct().union(left.select(F.col("b").alias("node")).distinct()).distinct()
        wanted = cut(ends.join(nodes.select("node", "row", "n"), "node"))
        # Nodes are dealt to blocks, and pairs to cells of two blocks, so that a cell's sets take some CELL_BYTES.
        count, total = wanted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        blocks = max(LEAST_BLOCKS, -(-8 * total // CELL_BYTES))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        celled = left.select((block("a") * blocks + block("b")).alias("cell"), "a", "b")
        bits = min(WANTED_BITS, 1 << max(15, (16 * count).bit_length()))
        marks = _wanted_bits(wanted, bits)

        def read(rows: dict[str, list]) -> dict[str, list]:
            """Sets of rows that may be wanted, so that few texts are hashed again and none is shuffled."""
            some = [i for i, p in enumerate(rows["p"]) if marks[p >> 3] >> (p & 7) & 1]
            return {"row": [rows["row"][i] for i in some], "x": [shingle_hashes(rows["_text"][i], shingle).tobytes() for i in some]}

        maybe = map_columns(texts.select(row_name(key).alias("row"), "_text").withColumn("p", _place(bits)), "row binary, x binary", read)
        sets = cut(maybe.join(wanted, "row").groupBy("row", "node").agg(F.first("x").alias("x")).select("node", "x"))
        needed = celled.select("cell", F.col("a").alias("node")).distinct().union(celled.select("cell", F.col("b").alias("node")).distinct()).distinct()
        own = needed.join(sets, "node").select("cell", F.lit(0).alias("role"), F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "x")
        met = own.unionByName(celled.select("cell", F.lit(1).alias("role"), "a", "b", F.lit(None).cast("binary").alias("x")))
        good = cut(met.repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(_alike(similarity), "a bigint, b bigint"))
        discard(left, wanted, sets)
        release(good.sparkSession)
        return good

    # Trees over distinct fingerprints; sets with one fingerprint are neighbours.
    distinct = cut(outlines.groupBy("fp").agg(F.min("node").alias("node")).select("node", "fp"))
    by_print = near_links(distinct)
    of_print = outlines.select(F.col("fp").alias("h"), "node", F.lit(0).cast("bigint").alias("pos"))
    sized = lambda c: F.shiftright(c, NODE_BITS)
    by_print = by_print.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(sized("b") + 1e-6 >= similarity * sized("a"))
    near = by_print.union(neighbours(shared.union(of_print).withColumn("label", F.col("node"))))
    first = cut(near.distinct())
    found = links(first)
    discard(first, distinct)
    labelled = classed(found)
    nearest = _cells(labelled, outlines.select("node", "sketch")).mapInArrow(_crossing(similarity, NEAREST), "a bigint, b bigint")
    again = cut(nearest.distinct())
    more = links(again)
    found, before = cut(found.union(more)), found
    discard(labelled, before, more)
    labelled = classed(found)
    crossing = _cells(labelled).mapInArrow(_crossing(similarity), "a bigint, b bigint")
    rest = cut(crossing.distinct().join(again, ["a", "b"], "left_anti"))
    discard(labelled, again, shared)
    known = components(cut(found.union(links(rest))))
    discard(rest, outlines)
    classes = nodes.select("name", "node").join(known, "node", "left").select("name", F.coalesce("component", "node").alias("class"))
    return prints.select(key, "digest", "name").join(classes, "name").select(key, "digest", "class")


def similar_classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """key, component_id of every row: the smallest key reachable over links between texts of at least this similarity.

    Links are those of `similar_rows`. Rows that repeat a key with other texts have classes of their own. Rows with a
    null key link to nothing, and their component_id is null.
    """
    rows = cut(similar_rows(df.filter(F.col(key).isNotNull()), key, text, shingle, similarity))
    least = rows.groupBy("class").agg(F.min(key).cast("bigint").alias("component_id"))
    without = df.filter(F.col(key).isNull()).select(key, F.lit(None).cast("bigint").alias("component_id"))
    return rows.join(least, "class").select(key, "component_id").unionByName(without)


def near_classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp, component_id of every row; component_id is the smallest key reachable over links.

    Rows link if their fingerprints differ in at most RADIUS bits; equal texts have equal fingerprints. Texts without
    words (null, empty, blank) have fingerprint 0 and link like others. Rows with a null key have a fingerprint but
    link to nothing, and their component_id is null. Repeated rows share their class. Keys are integers.
    """
    prints = cut(fingerprints(df, key, text, shingle))
    # One node for each distinct fingerprint, named by its smallest key: copies are never compared with each other.
    nodes = cut(prints.filter(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).cast("bigint").alias("node")))
    found = components(near_links(nodes))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select(key, "fp", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
