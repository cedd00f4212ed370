import random
import re

import numpy as np
from pyspark.sql import functions as F

from tandemlake.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by their definitions."""
    text = text or ""
    w = WORD.findall(text)
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_equal_brute_force():
    rng = random.Random(4)
    cases = ["", " ", "\n\n\n", "a", "a b", "a a a", "a a a a", "a b c a b c d", "x\nx\n\n \n \ny\nx", "é ü b c 中文", "#a*b $%&|<> ##"]
    for _ in range(150):
        cases.append("".join(rng.choice(["a", "b", "cc", " ", "  ", "\n", "\t", "\x0b", "\x1f", "#", "é", "!", "7", "Q"]) for _ in range(rng.randrange(120))))
    for t in cases:
        assert rules.text_counts(t)[:5] == brute(t), t


def plain_path(tree, x, node=0, depth=0):
    """The path length of a row in one tree, node by node."""
    feature, at, left, right, length = tree[node]
    if left == node:
        return length
    return plain_path(tree, x, int(left if x[int(feature)] < at else right), depth + 1)


def test_forest_equals_walks_of_single_trees():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (300, 3)), [[9, 9, 9], [0, 0, 30]], np.repeat([[1.0, 1.0, 1.0]], 50, axis=0)])
    forest = rules.grow_forest(x, trees=20, tree_rows=64)
    got = forest.anomaly(x)
    table = np.stack([forest.feature, forest.at, forest.left, forest.right, forest.depth], axis=2)
    for i in (0, 5, 300, 301, 320):
        mean = np.mean([plain_path(t, x[i]) for t in table])
        assert abs(got[i] - 2 ** (-mean / float(rules.mean_path(64)))) < 1e-12
    assert got[300] > np.quantile(got[:300], 0.95) and got[301] > np.median(got)
    assert ((got > 0) & (got < 1)).all() and len(set(got[302:])) == 1
    assert rules.grow_forest(np.zeros((0, 3))).anomaly(x).tolist() == [0.0] * len(x)
    assert len(set(rules.grow_forest(np.ones((9, 3))).anomaly(np.ones((2, 3))))) == 1
    # Every row of a tree ends in the leaf whose rows were counted: a tree grown whole tells all rows apart.
    whole = rules.grow_tree(np.arange(8.0)[:, None], rng, 99)
    assert sorted(n[4] for n in whole if n[2] == whole.index(n)) and sum(n[2] == i for i, n in enumerate(whole)) == 8


def test_mean_path_by_its_recurrence():
    """The mean depth of a row in trees of uniform splits of n places."""
    c = [0.0, 0.0, 1.0]
    for n in range(3, 40):
        c.append(1 + 2 * sum(k * c[k] for k in range(1, n)) / (n * (n - 1)))
    # The usual formula takes ln for harmonic numbers.
    assert all(abs(float(rules.mean_path(n)) - c[n]) <= 1 / (n - 1) for n in range(2, 40))


def test_threshold_is_the_best_of_all(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(2), rng.random() ** 2) for _ in range(300)] + [(0, 0.95)] * 40
    got = rules.calibrated(spark.createDataFrame(rows, "quality int, anomaly double"))
    good, bad = ([a for q, a in rows if q == k] for k in (1, 0))

    def gain(limit):
        return sum(int(a * 1000) / 1000 >= limit for a in bad) / len(bad) - rules.GOOD_WEIGHT * sum(int(a * 1000) / 1000 >= limit for a in good) / len(good)

    assert abs(gain(got) - max(gain(i / 1000) for i in range(1001))) < 1e-12
    one = spark.createDataFrame([(1, 0.4)], "quality int, anomaly double")
    assert rules.calibrated(one) == 2.0 and rules.calibrated(one.limit(0)) == 2.0


def test_quality_rules_on_the_corpus(spark):
    folder = "/root/testdata/sf0.01"
    got = rules.op12_quality_rules(spark, folder).toPandas().set_index("doc_id")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for k in list(docs)[::9]:
        if len(docs[k] or "") < 20_000:
            assert tuple(got.loc[k, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == brute(docs[k])
    failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
    assert (got["base_failed"] == failed).all() and not (got["kept"] & failed).any()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")
    both = got[~failed].join(labels, how="inner")
    assert both[both["quality"] == 1]["kept"].mean() > 0.97
    assert both[both["quality"] == 0]["kept"].mean() < 0.3


def test_quality_rules_of_odd_rows(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(6, 1), (17, 0), (17, 1), (None, 0), (3, None), (5, 7)], "doc_id bigint, quality int")
    got = rules.judge_rules(edge_docs, labels)
    assert got.columns == ["doc_id", *rules.COUNTS, "base_failed", "anomaly", "kept"] and got.count() == edge_docs.count()
    found = {r["doc_id"]: r for r in got.collect()}
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    assert all(tuple(found[k][c] for c in rules.COUNTS[:5]) == brute(t) for k, t in texts.items() if len(t or "") < 9_000)
    assert not found[0]["kept"] and found[0]["base_failed"] and found[12]["base_failed"]  # null, and one word repeated
    assert rules.judge_rules(empty_docs, labels).count() == 0
    words = " ".join(f"w{i} and" for i in range(40))
    plain = spark.createDataFrame([(i, f"{words} {i}") for i in range(30)] + [(None, words), (None, words)], "doc_id bigint, text string")
    assert rules.judge_rules(plain, labels.limit(0)).filter("kept").count() == 32
    assert rules.judge_rules(plain, labels).filter(F.col("doc_id").isNull() & F.col("kept")).count() == 2
