"""Importance resampling towards a target distribution, by inverted postings that are partitioned by bucket.

Hashed word and word-pair features fall into buckets. Each document's postings (bucket, document, count) are shuffled to
the partition of their block of buckets; a bucket's gain, the scaled log ratio of its shares in the target and in the
source corpus, is computed from the two corpora's counts of that bucket, co-grouped by bucket; each partition turns its
postings into contributions by the gains of its block, and contributions are reduced by document. A document's weight,
the mean gain of its features, and Gumbel noise from its id then rank it, so that the highest scores are a sample
without replacement.

Postings of a document in one block travel as one row of packed numbers. Blocks are dealt to SALTS partitions each, so a
bucket that all documents share is no task's alone.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import cut, map_columns, read_table

BUCKETS = 10_000
#: Blocks of neighbouring buckets, and partitions to which the postings of a block are dealt.
BLOCKS = 8
SALTS = 1_024
#: Longest run of words that is a feature.
MAX_RUN = 2
#: Scores and gains are in thousandths.
SCALE = 1_000
SEED = 7
#: Words of a document that may be drawn, and the share of those documents in percent that is.
LEAST_WORDS = 20
PERCENT = 25

_WIDTH = -(-BUCKETS // BLOCKS)
# In UTF-8 every byte of a character beyond ASCII is above 0x7F, so words can be found in bytes.
_WORD = regex.compile(rb"[0-9a-z\x80-\xff]+")


def feature_buckets(text: bytes) -> np.ndarray:
    """The bucket of each word, then of each pair of neighbouring words (joined by a space), of a text in UTF-8."""
    words = _WORD.findall(text.lower())  # of bytes, only A-Z change
    single = list(map(zlib.crc32, words))
    # A checksum goes on from the first word's, so pairs are never put together.
    double = list(map(zlib.crc32, [b" " + w for w in words[1:]], single))
    return (np.array(single + double, dtype=np.uint32) % BUCKETS).astype(np.int64)


def packed_counts(text: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(block, features, buckets, counts) of a text: buckets as 16-bit, counts as 8-bit numbers or, if one needs them,
    64-bit ones. A text without words has one empty row in block 0."""
    buckets, counts = np.unique(feature_buckets(text), return_counts=True)
    out = []
    ends = np.searchsorted(buckets, np.arange(BLOCKS + 1) * _WIDTH)
    for block, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b > a or block == 0:
            c = counts[a:b]
            kind = np.uint8 if b == a or c.max() < 256 else np.int64
            out.append((block, int(c.sum()), buckets[a:b].astype("<u2").tobytes(), c.astype(kind).tobytes()))
    return out


def unpacked(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(buckets, "<u2")
    return b, np.frombuffer(counts, np.uint8 if len(counts) == len(b) else np.int64).astype(np.int64)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest (of the text), salt, block, features, buckets, counts: a row for each document and block it meets."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out = {name: [] for name in ("key", "digest", "salt", "block", "features", "buckets", "counts")}
        for k, t, at in zip(rows["key"], rows["text"], rows["at"]):
            digest = blake2b(t, digest_size=12).digest()
            for block, n, b, c in packed_counts(t):
                row = (k, digest, at % SALTS, block, n, b, c)  # in turn, so copies of one row go to all salts
                for name, value in zip(out, row):
                    out[name].append(value)
        return out

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, digest binary, salt int, block int, features bigint, buckets binary, counts binary"
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return map_columns(source.withColumn("at", F.monotonically_increasing_id()), schema, work)


def bucket_counts(rows: DataFrame, name: str) -> DataFrame:
    """bucket, `name`: features in each bucket. Every slice of rows is summed in place before the shuffle."""

    def work(part: dict[str, list]) -> dict[str, list]:
        total = np.zeros(BUCKETS, np.int64)
        for b, c in zip(part["buckets"], part["counts"]):
            at, n = unpacked(b, c)
            total[at] += n
        hit = np.flatnonzero(total)
        return {"bucket": hit.tolist(), name: total[hit].tolist()}

    return map_columns(rows.select("buckets", "counts"), f"bucket int, {name} bigint", work).groupBy("bucket").agg(F.sum(name).alias(name))


def bucket_gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain from the buckets' counts s in the source and t in the target, co-grouped by bucket."""
    both = source.join(target, "bucket", "full_outer").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s"), F.sum("t")).first()
    s, t = (float(v or 0) + BUCKETS for v in sums)
    ratio = (F.col("t") + 1).cast("double") * F.lit(s) / ((F.col("s") + 1).cast("double") * F.lit(t))
    return both.select("bucket", F.floor(F.log(ratio) * SCALE).alias("gain"))


def contributions(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """key, digest, copies (1 in block 0), features, gain of each document in each block."""
    shared = rows.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers

    def work(part: dict[str, list]) -> dict[str, list]:
        own = shared.value
        gain = []
        for b, c in zip(part["buckets"], part["counts"]):
            at, n = unpacked(b, c)
            gain.append(int((own[at] * n).sum()))
        return {"key": part["key"], "digest": part["digest"], "copies": [int(b == 0) for b in part["block"]], "features": part["features"], "gain": gain}

    schema = f"key {rows.schema['key'].dataType.simpleString()}, digest binary, copies bigint, features bigint, gain bigint"
    return map_columns(rows.drop("salt"), schema, work)


def importance_weights(docs: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_features, weight of every row: the floored mean gain of its features, 0 without any.

    docs: key, text. target: text. Null texts are empty. Rows with a null key, and rows that repeat a key, with the same
    text or another, are weighted each by its own text and all returned; empty tables count as corpora without features.
    """
    # Written once as they lie after the shuffle, and read twice: for the counts and for the contributions.
    inverted = cut(postings(docs, key).repartition("block", "salt"))
    targets = postings(target.select(F.lit(0).alias(key), "text"), key)
    gains = np.zeros(BUCKETS, np.int64)
    for r in bucket_gains(bucket_counts(inverted, "s"), bucket_counts(targets, "t")).collect():  # BUCKETS rows at most
        gains[r["bucket"]] = r["gain"]
    per = contributions(inverted, gains).groupBy("key", "digest").agg(*[F.sum(c).alias(c) for c in ("copies", "features", "gain")])
    # Copies of a row multiply features and gain alike, so their quotient is each copy's own.
    weight = F.when(F.col("features") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, features)) div features"))
    each = per.select("key", (F.expr("features div copies")).alias("n_features"), weight.cast("bigint").alias("weight"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return each.select(F.col("key").alias(key), "n_features", "weight")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Noise in thousandths from the hash of an id (a null id being the empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -SCALE)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """key, n_features, weight, score, rank of every row; rank is null for rows that are not drawn.

    Of the rows with at least `least_words` words, floor(percent * rows / 100) with the highest scores are drawn and
    ranked from 1 on; of equal scores the smaller key goes first (null keys before all), then the lower weight and the
    fewer features. Further ties are rows that are equal in all returned columns. Other columns of the tables are unused.
    """
    scored = importance_weights(docs, target, key).withColumn("score", F.col("weight") + gumbel(F.col(key)))
    # A text of w words has w words and w - 1 pairs as features.
    eligible = F.col("n_features") >= MAX_RUN * least_words - 1
    ranked = numbered(scored, [(~eligible).cast("int"), -F.col("score"), key, "weight", "n_features"])
    drawn = ranked.agg(F.coalesce(F.sum(eligible.cast("bigint")), F.lit(0))).first()[0] * percent // 100
    rank = F.when(eligible & (F.col("number") <= drawn), F.col("number"))
    return ranked.select(key, "n_features", "weight", "score", rank.alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("text"))


#: Checksums are spelled out byte by byte, by a table from its polynomial.
OP11_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT r, true AS own, text FROM d UNION ALL SELECT row_number() OVER (), false, coalesce(text, '') FROM benchmark),
words AS (SELECT r, own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT r, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
n AS (SELECT r, own, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                                lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
      FROM h, tab),
p AS (SELECT r, own, bucket, sum(n)::BIGINT AS n FROM n JOIN b USING (f) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM p GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))))::BIGINT AS gain FROM c),
w AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM p JOIN g USING (bucket) WHERE own GROUP BY r),
k AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
             ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN w USING (r)),
v AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS i, sum((n_features >= 39)::INT) OVER () AS many FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND i <= 25 * many // 100 THEN i END AS rank FROM o
"""
