import hashlib
import struct

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tandemlake.llm import winnowing as w

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{N}])+")


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def rotated(x, by):
    return (x << by | x >> (64 - by)) & (2**64 - 1)


def mixed(h):
    return signed(xxhash.xxh64_intdigest(struct.pack("<Q", h), seed=42))


def rolling(hs, size):
    """Each run's hash from that of the run before."""
    h, out = 0, []
    for i, t in enumerate(hs):
        h = rotated(h, 1) ^ t % 2**64
        if i >= size:
            h ^= rotated(hs[i - size] % 2**64, size)
        if i >= size - 1:
            out.append(h)
    return out


def tokens(text):
    return [signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for t in TOKEN.findall((text or "").translate(FOLD))]


def brute(text):
    """Every window looked at on its own."""
    hs = tokens(text)
    if not text:
        return []
    if not hs:
        grams = [signed(xxhash.xxh64_intdigest(text.translate(FOLD).encode(), seed=42))]
    else:
        grams = [mixed(h) for h in rolling(hs, min(w.GRAM, len(hs)))]
    chosen = set()
    for a in range(max(1, len(grams) - w.WINDOW + 1)):
        window = range(a, min(a + w.WINDOW, len(grams)))
        chosen.add(min(window, key=lambda i: (grams[i] >> 31, -i)))
    return [(grams[i], i) for i in sorted(chosen)]


def likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_of_edge_texts(edge_docs):
    got = w.with_fingerprint(edge_docs, "text", "print").select("text", "print", "fp").collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert [(f["hash"], f["pos"]) for f in r["print"]] == brute(r["text"])
        assert r["fp"] == "clash"


def test_shared_passage_is_found(spark):
    passage = " ".join(f"shared{i}" for i in range(w.WINDOW + w.GRAM - 1))
    a = " ".join(f"left{i}" for i in range(50)) + " " + passage + " tail"
    b = "head " + passage + " " + " ".join(f"right{i}" for i in range(31))
    df = w.with_fingerprint(w.with_fingerprint(spark.createDataFrame([(a, b)], "a string, b string"), "a", "fa"), "b", "fb")
    met = df.select(w.shared_passages(F.col("fa"), F.col("fb")).alias("m")).first()["m"]
    assert met and all(m["pos_a"] - m["pos_b"] == 49 for m in met)


@pytest.mark.parametrize("per_run", [3, 512])
def test_query_equals_brute_force(spark, sf, monkeypatch, per_run):
    monkeypatch.setattr(w, "ROWS_PER_RUN", per_run)
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in w.op1_winnowing(spark, sf).collect()}
    assert len(got) == len(rows)
    prints = [brute(r["text"]) for r in rows]
    for i, r in enumerate(rows):
        text, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        x = got[r["doc_id"]]
        assert (x["n_chars"], x["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert x["fingerprint"] == ",".join(f"{h & (2**64 - 1):x}:{p}" for h, p in prints[i])
        assert x["near_edited"] == pytest.approx(likeness(prints[i], brute(edited)))
        assert x["near_next"] == pytest.approx(likeness(prints[i], prints[(i + 1) % len(rows)]))


@pytest.mark.parametrize("per_run", [2, 512])
def test_next_of_repeats_nulls_and_empty(spark, edge_docs, empty_docs, monkeypatch, per_run):
    monkeypatch.setattr(w, "ROWS_PER_RUN", per_run)
    many = [(7, f"seven {i}") for i in range(40)] + [(None, f"none {i}") for i in range(30)] + [(i, f"row {i}") for i in range(100, 130)]
    odd = spark.createDataFrame(many, "doc_id bigint, text string").unionByName(edge_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    odd = odd.select("doc_id", "text", F.lit("clash").alias("_run"), F.xxhash64("text").alias("hash"))
    got = w.with_next_text(odd, "doc_id", "text", "then").collect()
    assert len(got) == odd.count() and {r["_run"] for r in got} == {"clash"}
    order = sorted(((r["doc_id"], r["text"], r["hash"] % 2**40) for r in got), key=lambda r: (r[0] is None, -(r[0] or 0), -r[2], r[1]))
    after = {}
    for a, b in zip(order, order[1:] + order[:1]):
        after.setdefault(a[:2], []).append(b[1])
    for r in got:
        assert r["then"] in after[r["doc_id"], r["text"]]
    assert w.with_next_text(empty_docs.select("doc_id", "text"), "doc_id", "text", "then").count() == 0


def test_frequent_and_null_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(w, "ROWS_PER_RUN", 50)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i}") for i in range(3000)]
    runs = w.with_runs(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").groupBy("_w_run").count().collect()
    assert max(r["count"] for r in runs) < 250 and len(runs) > 40


def test_unlike_texts_without_tokens(spark):
    rows = spark.createDataFrame([("!!!", "???"), ("!!!", "!!!"), ("", None)], "a string, b string")
    df = w.with_fingerprint(w.with_fingerprint(rows, "a", "fa"), "b", "fb").select(w.likeness(F.col("fa"), F.col("fb")).alias("x"))
    assert [r["x"] for r in df.collect()] == [0.0, 1.0, 1.0]
