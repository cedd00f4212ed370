"""Document fingerprints by winnowing, in built-in functions only.

A text is cut into tokens (runs of letters and digits; an ideograph or kana is a token by itself). Each run of GRAM
tokens has a rolling hash, a cyclic polynomial: rotations and exclusive ors of its tokens' hashes, so that the hash of
each run follows from that of the run before. Runs are put together from runs of half their length, which neighbours
share, so all of a text's hashes take a few steps over arrays. In each window of WINDOW successive hashes the smallest is chosen, of equal ones the rightmost.
Chosen hashes are kept with their positions. So any passage of at least WINDOW + GRAM - 1 = 12 tokens that two texts
share leaves a common hash in both, at positions that tell where it stands; no shared passage of fewer than GRAM tokens
is ever reported.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_ascii, read_table, whole_text

GRAM = 5
WINDOW = 8  # a power of two: minima over windows are found by doubling
TOKENS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"
#: Low bits of a window's sort key: they count positions down, so the smallest key is the rightmost of equal hashes.
POSITION_BITS = (1 << 31) - 1
#: Documents in a run of neighbours, on average, and the most runs of keys.
ROWS_PER_RUN = 512
MAX_RUNS = 100_000


def rotated(x: Column, by: int) -> Column:
    """64 bits turned to the left."""
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: array<struct<hash bigint, pos int>>, by position.

    Texts of 1 to GRAM - 1 tokens have one hash, of all their tokens; other texts without tokens (only punctuation) one of
    all their characters; empty and null texts have an empty array. Texts with fewer hashes than a window have the
    smallest of all. Equal texts have equal fingerprints. Temporary columns start with `_w_`.
    """
    n, folded = F.size("_w_grams"), fold_ascii(F.coalesce(F.col(text), F.lit("")))
    tokens = F.col("_w_tokens")

    def later(values: Column, step: int) -> Column:
        """The values from `step` places on."""
        return F.slice(values, step + 1, F.greatest(F.size(values), F.lit(1)))

    def smaller(keys: Column, step: int) -> Column:
        return F.zip_with(keys, later(keys, step), lambda a, b: F.least(a, b))

    def joined(left: Column, right: Column, size: int) -> Column:
        """Hashes of runs, from those of their left parts and of their right parts of `size` tokens."""
        return F.zip_with(left, right, lambda a, b: rotated(a, size).bitwiseXOR(b))

    df = df.withColumn("_w_tokens", F.regexp_extract_all(folded, F.lit(TOKENS), F.lit(0)))
    df = df.withColumn("_w_tokens", F.transform("_w_tokens", lambda t: F.xxhash64(t)))
    # GRAM = 5: pairs, pairs of pairs, and one more token.
    df = df.withColumn("_w_two", joined(tokens, later(tokens, 1), 1))
    df = df.withColumn("_w_four", joined(F.col("_w_two"), later(F.col("_w_two"), 2), 2))
    full = F.slice(joined(F.col("_w_four"), later(tokens, 4), 1), 1, F.greatest(F.size(tokens) - (GRAM - 1), F.lit(0)))
    short = F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, t: rotated(a, 1).bitwiseXOR(t))
    df = df.withColumn(
        "_w_grams",
        F.when(F.length(folded) == 0, F.array().cast("array<bigint>"))
        .when(F.size(tokens) == 0, F.array(F.xxhash64(folded)))
        .otherwise(F.transform(F.when(F.size(tokens) < GRAM, F.array(short)).otherwise(full), lambda h: F.xxhash64(h))),
    )
    df = df.withColumn("_w_keys", F.transform("_w_grams", lambda h, i: h.bitwiseAND(F.lit(~POSITION_BITS)).bitwiseOR((F.lit(POSITION_BITS) - i).cast("bigint"))))
    step = 1
    while step < WINDOW:
        df = df.withColumn("_w_keys", smaller(F.col("_w_keys"), step))
        step *= 2
    chosen = F.array_distinct(F.slice("_w_keys", 1, F.greatest(n - (WINDOW - 1), F.lit(1))))
    df = df.withColumn("_w_at", F.transform(chosen, lambda k: (F.lit(POSITION_BITS) - k.bitwiseAND(F.lit(POSITION_BITS))).cast("int")))
    df = df.withColumn(out, F.transform("_w_at", lambda p: F.struct(F.get("_w_grams", p).alias("hash"), p.alias("pos"))))
    return df.drop("_w_tokens", "_w_two", "_w_four", "_w_grams", "_w_keys", "_w_at")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes against all distinct hashes of two fingerprints; 1 if both are empty."""
    x, y = F.transform(a, lambda f: f["hash"]), F.transform(b, lambda f: f["hash"])
    both, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / F.greatest(every, F.lit(1)).cast("double"))


def as_string(fingerprint: Column) -> Column:
    """`hash:position` in order, hashes as hexadecimal digits, comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda f: F.concat_ws(":", F.lower(F.hex(f["hash"])), f["pos"].cast("string"))), ",")


def shared_passages(a: Column, b: Column) -> Column:
    """Pairs of positions (in a, in b) at which two fingerprints have the same hash."""
    return F.flatten(
        F.transform(a, lambda f: F.transform(F.filter(b, lambda g: g["hash"] == f["hash"]), lambda g: F.struct(f["pos"].alias("pos_a"), g["pos"].alias("pos_b"))))
    )


def with_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Add `_w_mix`, a hash of the text, and `_w_run`: rows of neighbouring keys share a run.

    Runs ascend in the order of `with_next_text`. A key that fills several runs, or null, is split by `_w_mix`, so no run
    depends on how often a key comes.
    """
    key_col, unit = F.col(key), F.col("_w_mix") / float(1 << 40)
    df = df.withColumn("_w_mix", F.pmod(F.xxhash64(text), F.lit(1 << 40)))
    # Literal arrays, folded from text: one expression however many values there are.
    array = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    n, nulls = df.agg(F.count("*"), F.count_if(key_col.isNull())).first()
    runs = int(min(MAX_RUNS, max(1, n // ROWS_PER_RUN)))
    marks: list = []
    if runs > 1:
        shares = array([i / runs for i in range(1, runs)], "double")
        marks = df.agg(F.percentile_approx(key, shares, F.lit(max(10_000, 10 * runs))).alias("q")).first().q or []
    cuts = sorted(set(marks))
    times = Counter(marks)  # a key with a share of the rows is a mark more than once
    first = [0]
    for c in cuts:
        first.append(first[-1] + times[c])
    split = max(1, int(nulls // ROWS_PER_RUN))
    down = lambda parts: F.floor((1 - unit) * parts).cast("int")  # noqa: E731  larger hashes come first
    of_null = F.lit(len(marks) + 1) + F.least(down(split), F.lit(split - 1))
    if not cuts:
        return df.withColumn("_w_run", F.when(key_col.isNull(), of_null).otherwise(F.lit(0)))
    kind, wide = df.schema[key].dataType.simpleString(), 64
    coarse = F.size(F.filter(array(cuts[::wide], kind), lambda c: c < key_col))
    fine = F.slice(array(cuts, kind), F.greatest(coarse - 1, F.lit(0)) * wide + 1, wide)
    below = F.greatest(coarse - 1, F.lit(0)) * wide + F.size(F.filter(fine, lambda c: c < key_col))
    # Keys after the mark before and up to a mark; only the mark itself may have several runs, the last of which the others join.
    end = F.lit(len(marks)) - F.get(array(first, "int"), below)
    many = F.when(F.get(array(cuts, kind), below) == key_col, F.get(array([times[c] for c in cuts], "int"), below)).otherwise(1)
    return df.withColumn("_w_run", F.when(key_col.isNull(), of_null).otherwise(end - many + 1 + F.least(down(many), many - 1)))


def with_next_text(df: DataFrame, key: str, text: str, out: str, between=lambda df: df, carry: dict[str, str] | None = None) -> DataFrame:
    """Add `out`, the text of the next row by descending key; the last row's is the first row's.

    The rows of one run of keys are sorted in one task; a copy of the head of each run also goes to the run before it.
    So the table is shuffled once and no task sees all of it. Rows of equal keys are ordered by a hash of the text, then
    by text; null keys come last. `between` works on rows after the shuffle; `carry` names columns it adds whose next
    value is wanted too. Temporary columns start with `_w_`.
    """
    wanted = {text: out, **(carry or {})}
    runs = with_runs(df, key, text)
    # The heads: the first row of each run.
    top = runs.groupBy(F.col("_w_run").alias("_w_at")).agg(F.max(F.struct(F.col(key), F.col("_w_mix"))).alias("_w_top"))
    heads = (
        runs.join(F.broadcast(top), (F.col("_w_run") == F.col("_w_at")) & F.struct(F.col(key), F.col("_w_mix")).eqNullSafe(F.col("_w_top")))  # a row a run
        .groupBy("_w_at")
        .agg(F.min(text).alias(text))
    )
    in_order = Window.orderBy("_w_run")  # a row a run
    ends = top.select(F.col("_w_at").alias("_w_run")).withColumn("_w_then", F.coalesce(F.lead("_w_run").over(in_order), F.first("_w_run").over(in_order)))
    heads = heads.join(F.broadcast(ends), F.col("_w_at") == F.col("_w_then")).select("_w_run", text, F.lit(1).alias("_w_copy"))
    rows = between(runs.withColumn("_w_copy", F.lit(0)).unionByName(heads, allowMissingColumns=True).repartition("_w_run"))
    inside = Window.partitionBy("_w_run").orderBy("_w_copy", F.col(key).desc_nulls_last(), F.desc("_w_mix"), text)
    return rows.withColumns({o: F.lead(c).over(inside) for c, o in wanted.items()}).filter("_w_copy = 0").drop("_w_run", "_w_copy", "_w_mix")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    prints = lambda df: with_fingerprint(df, "text", "fp")
    pairs = with_next_text(docs, "doc_id", "text", "next_text", prints, {"fp": "next_fp"})
    n = F.length("text")
    changed = F.floor(n / 3).cast("int")
    pairs = pairs.withColumn("n_chars", n.cast("bigint")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - changed), F.substring(F.col("next_text"), F.lit(1), changed))
    )
    pairs = with_fingerprint(pairs, "edited", "edited_fp")
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
