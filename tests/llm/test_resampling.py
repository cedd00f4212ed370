import math
import re
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tandemlake.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) of each row, by the definition."""
    found = [(k, *features(t)) for k, t in docs]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in features(x)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(big_s + 10_000) / ((s[b] + 1) * float(big_t + 10_000)))) for b in s}
    rows = []
    for k, f, words in found:
        h = int(sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = math.floor(Fraction(sum(gain[b] for b in f), len(f))) if f else 0
        rows.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[2], r[1]))
    drawn = able[: 25 * len(able) // 100]
    return sorted([(*r[:4], i) for i, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in able[len(drawn) :] + [r for r in rows if not r[4]]], key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()], key=str)


def test_resampling_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = resampling.op11_resampling(spark, folder)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert result(got) == brute(docs, target)


def test_sql_equals_brute_force(spark):
    con = duckdb.connect()
    docs = [(1, "A b c " * 9), (2, None), (3, "Ünï " * 30 + "x"), (4, "b c d e f g h i j k l m n o p q r s t u v"), (5, "")] + [(i, f"w{i} x y z " * 10) for i in range(6, 20)]
    target = ["a b c d", None, "x y z"]
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame({"text": target}))
    got = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.OP11_SQL})").fetchall()
    assert sorted(got, key=str) == brute(docs, target)
    assert result(resampling.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(x,) for x in target], "text string"))) == brute(docs, target)


def test_resampling_of_odd_rows(spark, edge_docs, empty_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    long = (99, " ".join(f"w{i % 700} x" for i in range(60_000)))
    more = [long, long, (98, "word " * 300), (98, "word " * 299), (None, "a b c " * 30), (None, "a b c " * 30), (None, "")]
    frame = edge_docs.select("doc_id", "text", "score", "rank").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    target = ["The quick brown fox", "word word word", None, ""]
    targets = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    want = brute(docs + more, target)
    assert result(resampling.resample(frame, targets)) == want
    assert result(resampling.resample(frame.repartition(7), targets)) == want
    assert result(resampling.resample(frame, targets.limit(0))) == brute(docs + more, [])
    assert resampling.resample(empty_docs, targets).count() == 0
    drawn = resampling.resample(frame, targets, percent=100, least_words=0)
    assert drawn.filter(F.col("rank").isNull()).count() == 0


def test_packed_counts_hold_large_counts():
    text = b"a " * 300 + b"b"
    rows = resampling.packed_counts(text)
    assert sum(n for _, n, _, _ in rows) == 601
    both = Counter()
    for block, _, b, c in rows:
        for bucket, n in zip(*map(list, resampling.unpacked(b, c))):
            both[int(bucket)] += int(n)
            assert bucket // -(-resampling.BUCKETS // resampling.BLOCKS) == block
    assert both == Counter(features(text.decode())[0])
    assert resampling.packed_counts(b"?") == [(0, 0, b"", b"")]
