"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class k holds pieces of at most capacity // k tokens, and each of its sequences takes exactly k of them, wherever they
come from: no search for a fitting sequence, no state but a count. A document gives full sequences first. What is left
is put into the class it fits if that wastes little of a place; else a piece that fills a place of the next class
exactly is cut off, and the rest goes on. Every worker counts the pieces of each class that it makes; sums of these
counts give each worker's first rank in a class, and rank // k is the sequence, rank % k the place. The pieces
that don't fill a last sequence of their class, fewer than the classes' sum however large the table, share sequences,
the longest first into the first that has room.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, held, map_columns, read_table, whole_text
from .wordids import MEMO_WORDS, WordIds

CAPACITY = 2048
END_ID = 1
#: Pieces of a sequence, by class. Sparse at the end, so that few classes have a last sequence with free places.
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 512, 1024, 2048)
#: The share of a place that may stay free before a piece is cut.
SLACK = 0.04


def cut_lengths(total: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of `total` tokens, in order; at most some ten beside full sequences."""
    out = [(capacity, 1)] * (total // capacity)
    rest = total % capacity
    places = [capacity // k for k in reversed(CLASSES) if k <= capacity]
    while rest:
        i = bisect_left(places, rest)
        if places[i] - rest <= slack * places[i] or places[i] <= 64:
            out.append((rest, len(places) - 1 - i))
            break
        out.append((places[i - 1], len(places) - i))
        rest -= places[i - 1]
    known = [k for k in CLASSES if k <= capacity]
    return [(n, 1) if n == capacity else (n, known[i]) for n, i in out]


def token_pieces(df: DataFrame, tokenizer: str, key: str, text: str, capacity: int, slack: float, with_ids: bool, memo_words: int = MEMO_WORDS) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens (and ids) of each piece, with its class, worker and rank there."""
    counts: dict[int, int] = {}

    def work(rows: dict[str, list]) -> dict[str, list]:
        ids = held(tokenizer, lambda: WordIds(tokenizer, memo_words))
        worker = TaskContext.get().partitionId()
        end = array("I", [END_ID]).tobytes()
        out: dict[str, list] = {c: [] for c in (key, "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "rank", "ids")}
        for k, data in zip(rows[key], ids.encode_batch(rows["_text"])):
            data += end
            at = 0
            for length, of in cut_lengths(len(data) // 4, capacity, slack):
                part = data[4 * at : 4 * (at + length)]
                rank = counts[of] = counts.get(of, -1) + 1
                row = (k, at, length, zlib.crc32(part), len(data) // 4, of, worker, rank, np.frombuffer(part, "<i4") if with_ids else None)
                for c, v in zip(out, row):
                    out[c].append(v)
                at += length
        return out

    typed = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {typed}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, worker int, rank bigint, ids array<int>"
    return map_columns(df.select(key, whole_text(text).alias("_text")), schema, work, counts.clear, holds=tokenizer)


def pack_documents(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, slack: float = SLACK, with_ids: bool = False,
    memo_words: int = MEMO_WORDS,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    Every row is a document; repeated rows are packed as often as they come. Null and empty texts are the end id alone.
    Each id of a document, with the end id, lies in exactly one piece. An empty table has no pieces. Other columns are
    ignored. sequence_id counts from 0 without gaps. memo_words: words that a Python worker remembers, for speed alone.
    """
    # Materialised once: ranks depend on how rows were dealt to workers.
    pieces = cut(token_pieces(df, tokenizer, key, text, capacity, slack, with_ids, memo_words))
    sizes = pieces.groupBy("class", "worker").agg(F.count("*").alias("n"))  # classes x workers rows
    earlier = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    first_rank = sizes.select("class", "worker", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_rank"))
    totals = sizes.groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").collect()  # a row for each class
    first_sequence, bases, full = 0, [], []
    for r in totals:
        bases.append(F.when(F.col("class") == r["class"], F.lit(first_sequence)))
        full.append(F.when(F.col("class") == r["class"], F.lit(r["n"] - r["n"] % r["class"])))
        first_sequence += r["n"] // r["class"]
    base, full = (F.coalesce(*x, F.lit(0)).cast("bigint") for x in (bases, full))
    ranked = pieces.join(first_rank, ["class", "worker"]).withColumn("rank", F.col("rank") + F.col("first_rank")).drop("first_rank", "worker")
    placed = ranked.filter(F.col("rank") < full).withColumn("sequence_id", base + F.floor(F.col("rank") / F.col("class")).cast("bigint"))
    names = placed.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)

    def share(rest: pd.DataFrame) -> pd.DataFrame:
        """At most the sum of the classes less one each, some 4,800 pieces."""
        rest = rest.sort_values(["length", "class", "rank"], ascending=[False, True, True])
        room: list[int] = []
        at = []
        for n in rest["length"]:
            i = next((i for i, free in enumerate(room) if free >= n), len(room))
            room[i:] = [capacity - n] if i == len(room) else [room[i] - n, *room[i + 1 :]]
            at.append(first_sequence + i)
        return rest.drop(columns="_all").assign(sequence_id=at)[names]

    left = ranked.filter(F.col("rank") >= full).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(share, fields)
    before = Window.partitionBy("sequence_id").orderBy("class", "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return placed.unionByName(left).select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *(["ids"] if with_ids else []))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
