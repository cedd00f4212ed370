"""Quality rules: counts of a text, fixed limits on them, and an isolation forest that judges all else.

Every whole text is counted once (words, symbols, repeated lines and words, and some more). Texts that fail a fixed limit
are out. Trees of random splits over the counts' ratios isolate unusual texts in few steps: the shorter a text's mean
path, the higher its anomaly. How high is too high is calibrated from all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_columns, read_table, whole_text

#: Fixed limits: a text with fewer words fails, as does one whose share of repeated words in percent is higher.
LEAST_WORDS = 50
MOST_REPEATED = 50
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Trees of the forest, and rows that each is grown on; the rows in all are a bounded sample drawn by a hash.
TREES = 128
TREE_ROWS = 256
SAMPLE_ROWS = 8_192
SEED = 12
#: Ratios are seen by the forest in whole steps of this size.
STEP = 0.1
#: Anomalies are compared in steps of 1 / STEPS.
STEPS = 1_000
#: A labelled good text that is lost weighs as much as so many bad ones that stay.
GOOD_WEIGHT = 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lone")


def _repeated(words: list) -> int:
    """Words within 3-word windows that are found twice or more, the first included."""
    if len(words) < 4:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    # Pairs are numbered before they become triples, so numbers stay below the square of the text's length.
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, of, n = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = n[of] > 1
    hit = np.zeros(len(words), dtype=bool)
    for i in range(3):
        hit[i : len(words) - 2 + i] |= again
    return int(hit.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """COUNTS of a text. Lines count if they hold a word; marks are `!` and `?`; a lone word has one byte."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at SPACES only
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    upper = len(data) - len(data.translate(None, bytes(range(65, 91))))
    return (
        len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)),
        _repeated(words), upper, text.count("!") + text.count("?"), sum(len(w) == 1 for w in words),
    )


def count_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and COUNTS of every row's whole text; a null text has no words. Repeated rows are kept."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = np.array([text_counts(t) for t in rows["_text"]], dtype=np.int64).reshape(-1, len(COUNTS))
        return {key: rows[key], **{c: found[:, i] for i, c in enumerate(COUNTS)}}

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return map_columns(docs.select(key, whole_text(text).alias("_text")), schema, work)


def fails_limits() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def ratios() -> list[Column]:
    """What the forest sees: symbols, marks and lone words for each word, and the share of capitals, in whole STEP.

    Smaller differences are chance, and a text's length plays no part. Repetition is left to the fixed limit: some
    repeated lines or words are as common in good texts as in bad ones, and rare in both.
    """
    words, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars"))
    return [F.round(x / STEP) for x in (F.col("n_symbols") / words, F.col("n_marks") / words, F.col("n_lone") / words, F.col("n_upper") / chars)]


def mean_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among n rows in a tree of random splits."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees side by side: of node i of tree t the split feature[t, i] < at[t, i] leads to the node left[t, i], else to
    the next one; a leaf leads to itself and has the path length depth[t, i]. rows: the rows that a tree was grown on."""

    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    rows: int

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path) of each row of x: between 0 and 1, high for rows that are soon alone."""
        if not len(self.feature) or not len(x):
            return np.zeros(len(x))
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        row = np.arange(len(x))[:, None]
        while True:
            low = x[row, self.feature[tree, node]] < self.at[tree, node]
            after = np.where(low, self.left[tree, node], self.right[tree, node])
            if (after == node).all():
                break
            node = after
        return 2.0 ** (-self.depth[tree, node].mean(axis=1) / max(float(mean_path(self.rows)), 1e-9))


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Nodes (feature, split, left, right, path length) of a tree of random splits; the root comes first."""
    nodes: list[list[float]] = [[0, 0.0, 0, 0, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        i, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        able = np.flatnonzero(high > low)
        if depth >= limit or not len(able):
            nodes[i] = [0, -np.inf, i, i, depth + float(mean_path(len(rows)))]
            continue
        f = int(rng.choice(able))
        at = rng.uniform(low[f], high[f])
        side = part[:, f] < at
        if not side.any():  # a split at the least value
            at, side = np.nextafter(low[f], np.inf), part[:, f] <= low[f]
        left, right = len(nodes), len(nodes) + 1
        nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
        nodes[i] = [f, at, left, right, 0.0]
        todo += [(left, rows[side], depth + 1), (right, rows[~side], depth + 1)]
    return nodes


def grow_forest(x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """A forest on the rows of x, each tree on `tree_rows` of them; without rows it has no trees and no anomalies."""
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(x))
    limit = max(1, int(np.ceil(np.log2(max(size, 2)))))
    grown = [grow_tree(x[rng.choice(len(x), size, replace=False)], rng, limit) for _ in range(trees if size else 0)]
    wide = max((len(t) for t in grown), default=0)
    table = np.array([t + [[0, -np.inf, 0, 0, 0.0]] * (wide - len(t)) for t in grown], dtype=np.float64).reshape(len(grown), wide, 5)
    return Forest(table[:, :, 0].astype(int), table[:, :, 1], table[:, :, 2].astype(int), table[:, :, 3].astype(int), table[:, :, 4], size)


def add_anomaly(counts: DataFrame, forest: Forest) -> DataFrame:
    """The rows of counts with `anomaly`, 0 to 1."""
    wide = len(ratios())
    shared = counts.sparkSession.sparkContext.broadcast(forest)  # TREES trees of at most 2 * TREE_ROWS nodes

    def work(rows: dict[str, list]) -> dict[str, list]:
        x = np.array(rows.pop("_x"), dtype=np.float64).reshape(-1, wide)
        return rows | {"anomaly": shared.value.anomaly(x)}

    names = counts.columns
    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in names) + ", anomaly double"
    return map_columns(counts.select(*names, F.array(*ratios()).alias("_x")), schema, work)


def calibrated(scored: DataFrame, good_weight: float = GOOD_WEIGHT) -> float:
    """The anomaly from which on a text goes: it maximises the share of bad rows above less good_weight times that of
    good rows above, over all rows (quality 0 or 1, anomaly). Of equally good limits the middle; without rows of both
    labels, or where no limit is of use, 2, which keeps all."""
    step = F.floor(F.col("anomaly") * STEPS).cast("int").alias("step")
    found = scored.groupBy(step, "quality").agg(F.count("*").alias("n")).collect()  # at most STEPS + 1 rows a label
    n = np.zeros((2, STEPS + 2))
    for r in found:
        n[r["quality"], r["step"]] = r["n"]
    if not n.sum(axis=1).all():
        return 2.0
    above = n[:, ::-1].cumsum(axis=1)[:, ::-1] / n.sum(axis=1)[:, None]  # share at or above each step
    gain = above[0] - good_weight * above[1]
    if gain.max() <= 0:
        return 2.0
    best = np.flatnonzero(gain == gain.max())
    run = best[: np.argmax(np.append(np.diff(best) > 1, True)) + 1]  # the first run of equally good limits
    return float(run[0] + run[-1]) / 2 / STEPS


def judge_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """key, COUNTS, base_failed, anomaly, kept of every row of docs (key, text).

    labels: key, quality (0 or 1; other values, null labels and null keys are ignored, and a key with both counts as 0).
    The forest grows on some `sample_rows` rows that pass the fixed limits, drawn by a hash of key and counts; all
    labelled rows that pass them set the threshold. Null, empty and blank texts fail the limits. Rows with a null key and
    rows that repeat a key are each judged by their own text; an empty table stays empty. Extra columns are dropped.
    """
    counts = cut(count_rules(docs, key).withColumn("base_failed", fails_limits()))  # some numbers a row: texts are read once
    passed = counts.filter("NOT base_failed")
    n = passed.count()
    # Smallest hashes of a share that holds twice the rows wanted: the same rows on every machine.
    share = min(1.0, 2 * sample_rows / max(n, 1))
    drawn = F.pmod(F.xxhash64(key, *COUNTS, F.lit(SEED)), F.lit(1_000_000))
    sample = passed.withColumn("drawn", drawn).filter(F.col("drawn") < share * 1_000_000).select("drawn", F.array(*ratios()).alias("x"))
    rows = sample.orderBy("drawn", "x").limit(sample_rows).collect()
    forest = grow_forest(np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(ratios())))
    known = labels.select(F.col(key), "quality").filter(F.col("quality").isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.min("quality").cast("int").alias("quality"))
    limit = calibrated(add_anomaly(passed.join(known, key), forest).select("quality", "anomaly"))
    kept = ~F.col("base_failed") & (F.floor(F.col("anomaly") * STEPS) / STEPS < limit)
    return add_anomaly(counts, forest).withColumn("kept", kept)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
