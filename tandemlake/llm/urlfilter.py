"""URL filters: a sort-merge range join between URLs and host/path rules.

A host is written with its labels reversed and each closed by a dot ("example.net" -> "net.example."), so "this host
and all its subdomains" is the interval of keys that start with the rule's key. Two such intervals are nested or
disjoint. URLs and rules are sorted together by key; while the sorted rows go by, a stack holds the rules whose
interval is open. The stack has one place for each label depth: a rule that opens takes the place of its depth, and an
entry is closed as soon as the key has left its interval. The running `last(...)` of each depth, over a single window,
is that stack, so the sweep needs one sort and constant memory for a row, in built-in functions only.

Rules of any number are cut into ranges of keys. A URL meets the rules of its range and those that enclose the range's
first key, at most one for each label of it: whatever rule of an earlier range covers a key of this one covers the first
key too. A range with many URLs is dealt to several sweeps.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_ascii, read_table

#: URLs and rules' hosts in a sweep, and ranges at most.
ROWS_PER_SWEEP = 2_000
MAX_RANGES = 10_000

#: The rules that the query applies: (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://` or for null."""
    return fold_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """A short list of rules as a table of literals."""
    row = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("action", "host", "path"), r)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*row)))


def _range_of(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted cuts are at most the key, looked up in blocks."""
    if not cuts:
        return F.lit(0)
    wide = 100
    array = lambda values: F.from_json(F.lit(json.dumps(values)), "array<string>")  # noqa: E731  folded to a literal
    coarse = F.greatest(F.size(F.filter(array(cuts[::wide]), lambda c: c <= key)) - 1, F.lit(0)) * wide
    return coarse + F.size(F.filter(F.slice(array(cuts), coarse + 1, wide), lambda c: c <= key))


def _range_starts(entries: DataFrame, n_rules: int) -> list[str]:
    """Keys of rules that begin a range, but for the first range."""
    size = max(ROWS_PER_SWEEP, -(-n_rules // MAX_RANGES))
    if n_rules <= size:
        return []
    sized = entries.select("key").repartitionByRange("key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id())
    parts = sized.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    # Every size-th key of each sorted part; a part's last stretch is shorter.
    starts = parts.filter((F.col("at") % size == 0) & ((F.col("at") > 0) | (F.col("part") > 0))).select("key").collect()  # at most MAX_RANGES and a row a part
    return sorted(r["key"] for r in starts)


def match_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of `urls`.

    urls: any columns; `url` names the one with the address. Columns of its own called host, path, rule or verdict, in
    any case, are replaced. rules: action, host, path. A rule fits its host and all subdomains if the URL's path starts with the
    rule's path; the longest rule (host and path together, then the longer host, then `block`) wins, else `default`
    holds with a null rule. Null URLs have empty host and path. Repeated rows are kept; an empty table of rules leaves
    every row to the default; rules with a null host or path are ignored.
    """
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rules = (
        rules.filter("host is not null and path is not null")
        .select("action", fold_ascii(F.col("host")).alias("host"), "path")
        .select("action", "host", "path", host_key(F.col("host")).alias("key"), F.size(F.split("host", r"\.", -1)).alias("depth"))
    )
    # A host's own rules in one entry, the longest path first.
    entries = rules.groupBy("key", "depth").agg(
        F.reverse(
            F.array_sort(
                F.collect_set(
                    F.struct(
                        (F.length("host") + F.length("path")).alias("size"),
                        F.length("host").alias("host_size"),
                        F.when(F.col("action") == "block", 1).otherwise(0).alias("strict"),
                        "path",
                        F.concat("host", "path").alias("rule"),
                        "action",
                    )
                )
            )
        ).alias("paths")
    )
    depths = sorted(r.depth for r in entries.select("depth").distinct().collect())  # at most the 127 labels of a host
    rows = urls.select(F.struct(*kept).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not depths:
        return rows.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    cuts = _range_starts(entries, entries.count())
    keyed = rows.withColumn("key", host_key(F.col("host"))).withColumn("range", _range_of(F.col("key"), cuts))
    # Rows of a range are dealt in turn to its sweeps, so a host with any share of the rows is spread.
    urls_in = keyed.groupBy("range").agg(F.greatest(F.lit(1), F.round(F.count("*") / ROWS_PER_SWEEP)).cast("bigint").alias("parts"))  # a row a range
    left = keyed.join(F.broadcast(urls_in), "range").select(
        "range", (F.monotonically_increasing_id() % F.col("parts")).alias("part"), "key", F.lit(1).alias("kind"),
        "row", "host", "path", F.lit(None).cast("int").alias("depth"), F.lit(None).cast(entries.schema["paths"].dataType).alias("paths"),
    )
    null = {c: F.lit(None).cast(left.schema[c].dataType).alias(c) for c in ("row", "host", "path")}
    placed = entries.withColumn("range", _range_of(F.col("key"), cuts))
    if cuts:
        # Rules on the way to a range's first key.
        first = F.explode(F.from_json(F.lit(json.dumps([[i, c] for i, c in enumerate(cuts, 1)])), "array<array<string>>"))
        ways = urls.sparkSession.range(1).select(first.alias("x")).select(F.col("x")[0].cast("int").alias("range"), F.col("x")[1].alias("start"))
        label = F.split("start", r"\.", -1)
        shorter = F.transform(F.sequence(F.lit(1), F.size(label) - 2), lambda n: F.concat(F.array_join(F.slice(label, 1, n), "."), F.lit(".")))
        ways = ways.filter(F.size(label) > 2).select("range", F.explode(shorter).alias("key"))
        placed = placed.unionByName(entries.join(F.broadcast(ways), "key").select(*placed.columns))
    right = placed.join(F.broadcast(urls_in), "range").select(
        "range", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", F.lit(0).alias("kind"), *null.values(), "depth", "paths",
    )
    order = Window.partitionBy("range", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.struct("key", "paths")
    swept = left.unionByName(right).select(
        "kind", "key", "row", "host", "path",
        *[F.last(F.when(F.col("depth") == d, opened), ignorenulls=True).over(order).alias(f"open_{d}") for d in depths],
    ).filter("kind = 1")

    def fitting(d: int) -> Column:
        stack = F.col(f"open_{d}")
        fits = F.filter(stack["paths"], lambda p: F.startswith(F.col("path"), p["path"]))
        return F.when(F.startswith(F.col("key"), stack["key"]), F.get(fits, F.lit(0)))

    best = F.greatest(*[fitting(d) for d in depths]) if len(depths) > 1 else fitting(depths[0])
    return swept.withColumn("best", best).select(
        "row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return match_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                   ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, host, path, action, rhost || rpath AS rule
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict
FROM m GROUP BY page_id, host, path
"""
