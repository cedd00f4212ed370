"""Quality classifier by compression: dictionaries of good and of bad text, and a calibrated size difference.

Two zstandard dictionaries are filled from labelled texts, one from good ones, one from bad ones. A text is compressed
in blocks with each; what it takes less with the good one than with the bad one, for each byte and block by block, is
its evidence. A logistic curve fitted on labelled texts that filled no dictionary turns evidence into the probability
of label 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, map_columns, read_table, whole_text

#: Labelled rows of each class that training reads, in expectation: a bounded sample, drawn by a hash of the id.
SAMPLE_ROWS = 1_200
#: Bytes taken of one labelled text for a dictionary, in slices spread over it, and of a dictionary in all.
TEXT_BYTES = 1_024
DICTIONARY_BYTES = 160_000
#: Bytes of a text compressed at a time; every block starts from the dictionary alone.
BLOCK = 512
#: A shorter last block doesn't count as the best or worst one.
LEAST_BLOCK = 64
#: Equal slices of a text longer than TEXT_BYTES characters that go to a dictionary, from all over it.
SLICES = 4
FEATURES = 6
LEVEL = 3
#: Probability of label 1 from which a text is predicted good.
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and the calibration: probability = 1 / (1 + exp(-(bias + weights . features)))."""

    good: bytes
    bad: bytes
    bias: float
    weights: tuple[float, ...]


@lru_cache(maxsize=2)  # of one model: a worker lives on through other models
def _compressor(content: bytes):
    import zstandard

    primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def evidence(good: bytes, bad: bytes, text: str) -> tuple[float, ...]:
    """What a whole text's blocks say, the difference of a block being what the good dictionary saves, for a byte.

    The mean difference, the least and the largest one, the size with the better dictionary, the mean of the negative
    differences and the share of bytes in blocks that have one.
    """
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not data.strip():
        return (0.0,) * FEATURES
    a, b = _compressor(good), _compressor(bad)
    total = least = below = worse = 0
    low, high = math.inf, -math.inf
    for at in range(0, n, BLOCK):
        part = data[at : at + BLOCK]
        x, y = len(a.compress(part)), len(b.compress(part))
        d = y - x
        total += d
        least += min(x, y)
        if d < 0:
            below += d
            worse += len(part)
        if len(part) >= min(LEAST_BLOCK, n):
            low, high = min(low, d / len(part)), max(high, d / len(part))
    return total / n, low, high, least / n, below / n, worse / n


def spread_slices(text: Column) -> Column:
    """Slices of TEXT_BYTES characters in all, spread evenly over a text, or the text itself if it is shorter."""
    n, each = F.length(text), TEXT_BYTES // SLICES
    cut = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring(text, ((n - each) * i / (SLICES - 1)).cast("int") + 1, F.lit(each)))
    return F.when(n <= TEXT_BYTES, text).otherwise(F.concat_ws("\n", cut))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias first) by Newton's method on standardised features, given back for plain ones."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(x)), (x - mean) / std])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * mean / std).sum()], w[1:] / std])


def train_quality(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on labelled rows for which `learn` holds; at most some `sample_rows` of each class are read.

    docs: doc_id, text. labels: doc_id, quality (0 or 1; other labels are ignored, as are rows with nulls; a document with
    both labels counts as 0). Without labelled texts of both classes the model gives the share of label 1 (one half
    without any) to every text.
    """
    known = labels.select("doc_id", "quality").filter(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = (sizes.get(1, 0) + 1) / (total + 2)
    constant = QualityModel(b"", b"", math.log(share / (1 - share)), (0.0,) * FEATURES)
    if len(sizes) < 2:
        return constant
    # Each row's hash decides, so the sample is the same on every machine and its size is bounded.
    share_of = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    chance = F.when(F.col("quality") == 1, min(1.0, sample_rows / sizes[1])).otherwise(min(1.0, sample_rows / sizes[0]))
    drawn = F.broadcast(known.filter(share_of(8) < chance))  # some 2 * sample_rows rows
    rows = docs.join(drawn, "doc_id").select("doc_id", "quality", whole_text().alias("text"))
    # One half fills the dictionaries, the other calibrates.
    fills = rows.filter(share_of(9) < 0.5).select("doc_id", "quality", spread_slices(F.col("text")).alias("part"))
    fills = fills.orderBy(F.xxhash64("doc_id"), "part").limit(4 * sample_rows).collect()

    def content(q: int) -> bytes:
        return "\n".join(r["part"] for r in fills if r["quality"] == q).encode("utf-8", "surrogatepass")[:DICTIONARY_BYTES]

    good, bad = content(1), content(0)

    def features(part: dict[str, list]) -> dict[str, list]:
        return {"quality": part["quality"], "f": [list(evidence(good, bad, t)) for t in part["text"]]}

    rest = map_columns(rows.filter(share_of(9) >= 0.5).select("quality", "text"), "quality int, f array<double>", features)
    rest = rest.orderBy("quality", "f").limit(4 * sample_rows).collect()  # whole texts stay on the executors
    x, y = np.array([r["f"] for r in rest]), np.array([float(r["quality"]) for r in rest])
    if not (good and bad and 0 < y.sum() < len(y)):
        return constant
    w = fit_logistic(x, y)
    # The sample holds the classes in other shares than the labels do.
    shift = math.log(sizes[1] / sizes[0]) - math.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1))
    return QualityModel(good, bad, float(w[0]) + shift, tuple(map(float, w[1:])))


def score_quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns `keep`, and score: the probability of label 1 of every row's whole text.

    Null, empty and blank texts have no evidence and get the score of the calibration's bias. Repeated rows are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES each
    names = [key, *keep]

    def work(rows: dict[str, list]) -> dict[str, list]:
        m = shared.value
        scores = []
        for t in rows["_text"]:
            z = m.bias + sum(w * f for w, f in zip(m.weights, evidence(m.good, m.bad, t)))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return {c: rows[c] for c in names} | {"score": scores}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", score double"
    return map_columns(docs.select(*names, whole_text(text).alias("_text")), schema, work)


def held_out() -> Column:
    return F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
