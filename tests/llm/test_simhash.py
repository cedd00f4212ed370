import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tandemlake.llm import simhash as s
from tandemlake.llm.graph import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= s.RADIUS:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(fps))]


def close_prints(n, seed):
    rng = random.Random(seed)
    out = {rng.getrandbits(64)}
    while len(out) < n:
        f = rng.choice(sorted(out)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out, key=lambda f: rng.random())


@pytest.mark.parametrize("together", [2, 10_000])
def test_tree_links_connect_what_all_links_connect(monkeypatch, together):
    monkeypatch.setattr(s, "TOGETHER", together)
    fps = close_prints(150, 5)
    links = s.tree_links(list(range(150)), fps, list(range(150)), fps)
    assert len(links) < 150 and all((fps[a] ^ fps[b]).bit_count() <= 3 * 150 for a, b in links)
    root = list(range(150))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == brute_classes(fps)


def test_search_follows_only_near_edges():
    fps = close_prints(300, 9)
    tree = s.BKTree()
    for f in fps:
        tree.add(f)
    for q in fps[::7]:
        assert sorted(tree.within(q, 3)) == [i for i, f in enumerate(fps) if (f ^ q).bit_count() <= 3]
    together = {}
    for place, who in tree.within_all(s.as_words(fps, 1), 3):
        for w in who.tolist():
            together.setdefault(w, []).append(place)
    assert all(sorted(together[i]) == [j for j, f in enumerate(fps) if (f ^ q).bit_count() <= 3] for i, q in enumerate(fps))


@pytest.mark.parametrize("size", [s.TREE_SIZE, 7])
def test_classes_with_split_shards(spark, monkeypatch, size):
    monkeypatch.setattr(s, "TREE_SIZE", size)
    fps = close_prints(200, 3)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node bigint, fp bigint")
    found = {r["node"]: r["component"] for r in components(s.near_links(nodes)).collect()}
    assert [found.get(i, i) for i in range(200)] == brute_classes(fps)


def test_edge_rows(edge_docs, empty_docs):
    got = s.near_classes(edge_docs).collect()
    assert len(got) == edge_docs.count()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    ids = sorted(i for i in texts if i is not None)
    want = dict(zip(ids, [ids[c] for c in brute_classes([brute_print(texts[i]) for i in ids])]))
    for r in got:
        assert r["fp"] & (2**64 - 1) == brute_print(texts[r["doc_id"]])
        assert r["component_id"] == want.get(r["doc_id"])
    assert s.near_classes(empty_docs).count() == 0


def test_query(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in s.op3_simhash(spark, sf).collect()}
    fps = [brute_print(t) for _, t in rows]
    for (i, _), f, c in zip(rows, fps, brute_classes(fps)):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{f:016x}", rows[c][0])


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 7), (301, 300), (300, 301)], "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {i: 0 for i in range(201)} | {300: 300, 301: 300}


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("size", [s.TREE_SIZE, 5])
def test_similar_classes(spark, monkeypatch, size):
    """Edits that keep a similarity of 0.9 link, texts below 0.5 don't, and classes are the smallest ids of their group."""
    monkeypatch.setattr(s, "TREE_SIZE", size)
    rng = random.Random(4)
    rows, group = [], []
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(150, 400))]
        for n in range(4):
            words = list(base)
            for _ in range(len(base) // 150 if n else 0):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words).upper() if n == 3 else " ".join(words)))
            group.append(g)
    rows += [(1000, ""), (1001, None), (1002, "  \n"), (1003, "two words"), (None, rows[0][1])]
    got = {r["doc_id"]: r["component_id"] for r in s.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    assert all(jaccard(sets[i], sets[i - i % 4]) > 0.9 for i in range(100))
    assert [got[i] for i in range(100)] == [4 * g for g in group]
    assert (got[1000], got[1001], got[1002], got[1003], got[None]) == (1000, 1000, 1000, 1003, None)


def test_set_fingerprint_counts_each_shingle_once():
    for words in ("a b c d e f g h", "one two", ""):
        once = s.shingle_hashes(words, 2)
        want = sum(1 << i for i in range(64) if 2 * sum(int(h) >> i & 1 for h in once) > len(once)) if len(once) else 0
        assert s.set_fingerprint(once) % (1 << 64) == want
    assert s.set_fingerprint(s.shingle_hashes("a b c d " * 3, 2)) == s.set_fingerprint(s.shingle_hashes("a b c d " * 9, 2))


def test_outlines_never_rule_out_what_is_alike():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for n in (0, 1, 3, 40, 400, 5000):
        for share in (0.5, 0.78, 0.8, 0.82, 0.95, 1.0):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            y = np.concatenate([x[: int(n * share)], rng.integers(0, 2**63, rng.integers(0, n // 9 + 1)).astype(np.uint64)])
            both, every = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            ok = s.may_be_alike(len(x), s.outline(x), len(y), s.outline(y), 0.8)
            assert ok or both < 0.8 * every
            other = rng.integers(0, 2**63, n).astype(np.uint64)
            ruled_out += not s.may_be_alike(n, s.outline(x), n, s.outline(other), 0.8)
    assert ruled_out >= 12
    full = np.zeros(1000, np.uint64)
    assert s.may_be_alike(1000, s.outline(full), 10, s.outline(np.arange(10, dtype=np.uint64)), 0.8)


@pytest.mark.parametrize("n", [0, 1, 10**6, 10**9, 10**11, 10**14])
def test_shards_stay_small(n):
    blocks, choices = s.shard_plan(n)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    assert cuts[-1] == 64 and n / 2 ** min(sum(cuts[i + 1] - cuts[i] for i in c) for c in choices) <= 2 * s.TREE_SIZE
    # Whatever three bits differ, some choice of blocks is free of them.
    for bits in ((0, 1, 2), (0, 20, 63), (15, 16, 33), (9, 31, 50)):
        hit = {next(i for i in range(blocks) if cuts[i] <= b < cuts[i + 1]) for b in bits}
        assert any(not hit & set(c) for c in choices)


def test_links_with_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "shard_plan", lambda n: (6, tuple(itertools.combinations(range(6), 3))))
    fps = close_prints(150, 8)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node bigint, fp bigint")
    found = {r["node"]: r["component"] for r in components(s.near_links(nodes)).collect()}
    assert [found.get(i, i) for i in range(150)] == brute_classes(fps)


@pytest.mark.parametrize("size", [3, 64, 4096])
def test_neighbours_in_batches_of_any_size(size):
    import pyarrow as pa

    rng = np.random.default_rng(size)
    h = np.sort(rng.integers(0, 300, 400))
    node = np.arange(400)
    pos = rng.integers(0, 9, 400)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (h, node, pos)], names=["h", "node", "pos"]) for i in range(0, 400, size)]
    got = [tuple(r.values()) for b in s._shared(iter(batches)) for r in b.to_pylist()]
    want = [(h[i], i, pos[i]) for i in range(400) if i in (0, 399) or h[i - 1] == h[i] or h[i + 1] == h[i]]
    assert got == want and list(s._shared(iter([]))) == []

    node = (rng.integers(80, 120, 400) << s.NODE_BITS) + np.arange(400)
    label = rng.integers(0, 5, 400)
    rows = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (h, node, pos, label)], names=["h", "node", "pos", "label"]) for i in range(0, 400, size)]
    got = sorted(tuple(r.values()) for b in s._neighbours(0.8, 3)(iter(rows)) for r in b.to_pylist())
    room = lambda i: (node[i] >> s.NODE_BITS) - pos[i]
    need = lambda i, j: math.ceil(0.8 / 1.8 * sum(node[k] >> s.NODE_BITS for k in (i, j)) - 1e-6)
    want = []
    for i in range(400):
        for j in range(i + 1, min(400, i + 4)):
            small, large = sorted(node[k] >> s.NODE_BITS for k in (i, j))
            if h[i] == h[j] and label[i] != label[j] and min(room(i), room(j)) >= need(i, j) and small >= 0.8 * large:
                want.append((max(node[i], node[j]), min(node[i], node[j])))
    assert got == sorted(want)


def edited(rng, base, share):
    """A copy with one contiguous passage of about this share of its words added, cut or replaced."""
    n = max(1, round(share * len(base)))
    at = rng.randrange(len(base) - n)
    fresh = [f"y{rng.randrange(10**6)}" for _ in range(n)]
    kind = rng.randrange(3)
    return base[:at] + ([] if kind == 1 else fresh) + base[at if kind == 0 else at + n :]


@pytest.mark.parametrize("size", [s.GROUP_ROWS, 7])
def test_similar_classes_equal_brute_force_with_contiguous_edits(spark, monkeypatch, size):
    """Pairs on both sides of 0.8, by passages and by single words, link exactly where their sets say so."""
    monkeypatch.setattr(s, "GROUP_ROWS", size)
    rng = random.Random(11)
    rows, near = [], 0
    for g in range(150):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 300))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(edited(rng, base, rng.uniform(0.05, 0.25))))]
    rows += [(len(rows) + i, " ".join([*(f"c{j}" for j in range(10)), f"tail{i}"])) for i in range(40)]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                near += 0.8 <= jaccard(sets[i], sets[j]) < 0.85
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert near >= 15
    got = {r["doc_id"]: r["component_id"] for r in s.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == root


def test_similar_classes_of_a_repeated_key(spark):
    rng = random.Random(2)
    a, b = (" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a), (3, b), (3, "alone here")]
    got = sorted(tuple(r) for r in s.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 3)]
    ids = {(r["doc_id"], r["digest"]): r["class"] for r in s.similar_rows(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(ids) == 5 and len(set(ids.values())) == 3


def test_few_pairs_of_many_near_copies_are_compared(spark, monkeypatch):
    """Copies with up to four edits: those with few link nearly all others, which a random neighbour seldom is."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(2_000)}" for _ in range(200)]
    texts = []
    for n in range(400):
        words = list(base)
        for _ in range(n % 5):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    compared, plain = [], s.map_columns

    def counting(df, schema, *more, **named):
        if schema == "a bigint, b bigint":
            compared.append(df.count())
        return plain(df, schema, *more, **named)

    monkeypatch.setattr(s, "map_columns", counting)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len({r["class"] for r in s.similar_rows(rows).collect()}) == 1
    assert len(compared) == 3 and sum(compared) < 12 * len(texts), compared


def test_nearest_of_a_cell_come_first():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.append(base[i:], rng.integers(0, 2**63, i).astype(np.uint64))) for i in range(40)]
    node = np.array([(len(x) << s.NODE_BITS) + i for i, x in enumerate(sets)])
    rows = [(7, 0, n, 0, 1 if i else 2, s.sketch(x)) for i, (n, x) in enumerate(zip(node.tolist(), sets))] + [(7, 1, int(node[0]), 0, 2, s.sketch(sets[0]))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["cell", "role", "node", "pos", "label", "sketch"])
    pairs = [tuple(r.values()) for b in s._crossing(0.8, 5)(iter([batch])) for r in b.to_pylist()]
    places = {(set(p) - {int(node[0])}).pop() & ((1 << s.NODE_BITS) - 1) for p in pairs}
    assert len(pairs) == 5 and max(places) <= 8
    every = [b.num_rows for b in s._crossing(0.8)(iter([batch]))]
    assert sum(every) > 30
