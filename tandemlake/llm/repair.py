"""Conversation repair: an error-correcting Earley parser over the roles of a conversation's rows.

A small weighted grammar says which sequences of roles are right, `(s?(ua)+)?`. Error productions let a row be deleted or
get another role, and let a row be inserted, each at a cost. The chart is filled from the last row to the first: every
item holds the least cost of repairing the rows after it, with the least audit (the edits' initials) of that cost. As an
edit goes in front of the audit of the rows after it, and an item's different edits have different initials, two audits
of one cost are told apart by their first letters alone; so items hold a link to the rest, not the text, and a
conversation of n rows takes time and memory in proportion to n. The completed chart is read off as the repair.

The parser sees one character for each row, not its text. Texts are shuffled once, sorted after their conversation's
audit, and hashed as they go by, so no conversation's texts are held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import read_table

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a conversation up to which the same sequence of rows is parsed once in a task.
MEMO_ROWS = 64

#: The grammar, read from the right: what may follow a row. A sequence from `start` on is a whole conversation, one from
#: `u` on what may follow a user's row, and so on. Each production reads a role and goes on as another symbol.
PRODUCTIONS = (("start", "s", "s"), ("start", "u", "u"), ("s", "u", "u"), ("u", "a", "u a"), ("u a", "u", "u"))
#: Symbols that may be empty: nothing need follow a whole pair, and a conversation may have no rows.
EMPTY = ("start", "u a")
#: Roles that an edit may give.
GIVEN = {"u": "user", "a": "assistant"}

_SYMBOLS = ("start", "s", "u", "u a")
_AT = {name: i for i, name in enumerate(_SYMBOLS)}
_RULES = tuple((_AT[lhs], role, _AT[rest]) for lhs, role, rest in PRODUCTIONS)
_NONE = 1 << 60


def _completed(column: list, came: list) -> None:
    """Insertions within a column: an item that is completed by a row of its own, until no item gets better.

    An item is (cost, initial, column and symbol of the rest); costs are positive, so the rounds end.
    """
    better = True
    while better:
        better = False
        for lhs, role, rest in _RULES:
            if role in GIVEN and column[rest][0] < _NONE:
                item = (column[rest][0] + INSERT, "I", len(came), rest)
                if item[:2] < column[lhs][:2]:
                    column[lhs] = item
                    better = True


def parse(rows: str) -> tuple[int, str, str]:
    """(cost, audit, roles) of the cheapest repair of a conversation, ties by the least audit.

    rows: for each row its role's initial, or `!` if the row must be deleted; in upper case if the row is truncated.
    roles: for each letter of the audit the initial that the row has after the repair; a blank for a deleted row.
    """
    none = (_NONE, "~", -1, -1)
    column = [(0, "", -1, -1) if name in EMPTY else none for name in _SYMBOLS]
    chart: list[list] = []
    _completed(column, chart)
    chart.append(column)
    for mark in reversed(rows):
        role, late = mark.lower(), TRUNCATED if mark.isupper() else 0
        before, at = chart[-1], len(chart) - 1
        # Scanned: the row is deleted, or read by a production as it is or with another role.
        column = [(c[0] + DELETE, "D", at, i) if c[0] < _NONE else none for i, c in enumerate(before)]
        if mark != "!":
            for lhs, wanted, rest in _RULES:
                if before[rest][0] < _NONE:
                    if role == wanted:
                        column[lhs] = min(column[lhs], (before[rest][0] + late, "K", at, rest))
                    if wanted in GIVEN:
                        column[lhs] = min(column[lhs], (before[rest][0] + late + REROLE, "R", at, rest))
        _completed(column, chart)
        chart.append(column)
    audit, roles = [], []
    symbol, cost = 0, chart[-1][0][0]
    at = len(chart) - 1
    while (item := chart[at][symbol])[1]:
        audit.append(item[1])
        roles.append(" " if item[1] == "D" else next(role for lhs, role, rest in _RULES if (lhs, rest) == (symbol, item[3])))
        at, symbol = item[2], item[3]
    return cost, "".join(audit), "".join(roles)


_parse_short = lru_cache(maxsize=20_000)(parse)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that damage leaves. Null roles and texts are one blank, as is a null id or
    turn in the key that decides the damage."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    named = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array_repeat(F.lit(0), 1))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def row_order() -> list[Column]:
    """Rows of a conversation by turn, nulls first; rows of one turn by role and text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _digest() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, initial, fault (blank, duplicate, truncated or null): the first fault of each row.

    rows: conv_id, turn, role, text. All windows lie within a conversation and hold no texts, only their digests.
    """
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    light = rows.select("conv_id", "turn", "role", _digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), last.alias("last"))
    light = light.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("last") == "", "blank").when(seen > 1, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return light.withColumn("fault", fault).drop("last")


def structure(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, roles of each conversation of marked rows."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "!").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    fault = F.coalesce(F.substring("fault", 1, 1), F.lit(" "))
    # One character is enough for both but for a truncated row of an unknown role, which is named `X`.
    code = F.when((F.col("fault") == "truncated") & (known == "?"), "X").otherwise(mark)
    # `marked` has brought a conversation's rows together; its windows keep that.
    found = rows.select("conv_id", "turn", "role", "digest", "initial", code.alias("code"), fault.alias("f"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, roles string"
    found = found.sortWithinPartitions("conv_id", *row_order())
    return _by_conversation(found.select("conv_id", "turn", "initial", "code", "f"), schema, _Structure)


class _Structure:
    """What one conversation's rows say, taken up row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.faults, self.illegal = conv_id, [], {"b": 0, "d": 0, "t": 0}, 0
        self.last, self.low, self.high, self.turns, self.turn = None, None, None, 0, None

    def add(self, row: dict) -> None:
        turn, initial = row["turn"], row["initial"]
        if turn is not None:
            # Rows come by turn, so a turn is new if it is not the last one.
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.codes.append(row["code"])
        if row["f"] in self.faults:
            self.faults[row["f"]] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial

    def result(self) -> Iterator[dict]:
        codes = "".join(self.codes)
        cost, audit, roles = (_parse_short if len(codes) <= MEMO_ROWS else parse)(codes)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        yield {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.faults["b"], "duplicate": self.faults["d"], "truncated": self.faults["t"],
            "illegal": self.illegal, "cost": cost, "audit": audit, "roles": roles,
        }


class _Repaired:
    """The digest of one repaired conversation: what was found of it comes first, then its rows in order."""

    def __init__(self, conv_id):
        self.hash, self.found, self.audit, self.roles, self.at, self.any = sha256(), None, "", "", 0, False
        self.conv_id = conv_id

    def _put(self, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(GIVEN[self.roles[self.at]] + ":")
            self.at += 1

    def add(self, row: dict) -> None:
        if row["found"] is not None:
            self.found = row["found"]
            self.audit, self.roles = self.found["audit"], self.found["roles"]
            return
        self._inserted()
        edit = self.audit[self.at]
        if edit != "D":
            self._put((row["role"] if edit == "K" else GIVEN[self.roles[self.at]]) + ":" + row["text"])
        self.at += 1

    def result(self) -> Iterator[dict]:
        self._inserted()
        yield {"conv_id": self.conv_id, **self.found, "repaired_sha256": self.hash.hexdigest()}


def _by_conversation(rows: DataFrame, schema: str, state: type) -> DataFrame:
    """Results of `state` for each run of rows with one conv_id, in the order of the partition, across batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(rows.sparkSession)
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        done: list[dict] = []
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                if current is None or current.conv_id != row["conv_id"]:
                    if current is not None:
                        done.extend(current.result())
                    current = state(row["conv_id"])
                current.add(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
                done = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([*done, *current.result()], schema=out)

    return rows.mapInArrow(run, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, repaired_sha256 of each conversation.

    rows: conv_id, turn, role, text without nulls in role and text; other columns are unused. Rows of a null conv_id are
    one conversation. Rows of one turn are taken by role, then by digest of the text. Rows that repeat role and text are
    duplicates, after the first. An empty table has no conversations.
    """
    parsed = structure(marked(rows))
    found = F.struct(*[c for c in parsed.columns if c != "conv_id"])
    none = lambda kind: F.lit(None).cast(kind)
    body = rows.select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text",
        F.lit(None).cast(parsed.select(found.alias("x")).schema["x"].dataType).alias("found"),
    )
    types = [(c, body.schema[c].dataType) for c in ("turn", "role", "digest", "text")]
    head = parsed.select("conv_id", F.lit(0).alias("kind"), *[none(t).alias(c) for c, t in types], found.alias("found"))
    streamed = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *row_order())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parsed.schema) + ", repaired_sha256 string"
    return _by_conversation(streamed.select("conv_id", "role", "text", "found"), schema, _Repaired)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = repair_conversations(damaged(rows))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(got, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in zero], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


#: Checksums are spelled out byte by byte, by a table from its polynomial. A step of the recursion takes up a row, from
#: the last to the first: each symbol holds its least (cost, audit, roles).
OP13_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))),
r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
              hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
r1 AS (SELECT * EXCLUDE (x), xor(list_reduce([4294967295] || list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                                 lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 20 AS kind FROM r0, tab),
r2 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
              CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
              unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS time FROM r1 WHERE kind <> 0),
r3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), time) AS i,
              regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, role[1] AS initial,
              lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM r3),
r5 AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r4),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r5 GROUP BY conv_id),
chart AS (
  SELECT conv_id, n AS i, {'c': 0, 'a': '', 'r': ''} AS z, {'c': 10, 'a': 'II', 'r': 'ua'} AS s, {'c': 5, 'a': 'I', 'r': 'a'} AS u, {'c': 0, 'a': '', 'r': ''} AS p FROM stats
  UNION ALL
  SELECT conv_id, i - 1, least(z, {'c': u1.c + 5, 'a': 'I' || u1.a, 'r': 'u' || u1.r}), least(s, {'c': u1.c + 5, 'a': 'I' || u1.a, 'r': 'u' || u1.r}), u1,
         least(p, {'c': u.c + 5, 'a': 'I' || u.a, 'r': 'u' || u.r})
  FROM (
    SELECT *, least(u, {'c': p.c + 5, 'a': 'I' || p.a, 'r': 'a' || p.r}) AS u1
    FROM (
      SELECT h.conv_id, h.i,
             least({'c': z.c + 2, 'a': 'D' || z.a, 'r': ' ' || z.r}, {'c': CASE WHEN del OR initial <> 's' THEN 1000000 ELSE 0 END + late + s.c, 'a': 'K' || s.a, 'r': 's' || s.r},
                   {'c': CASE WHEN del THEN 1000000 WHEN initial = 'u' THEN 0 ELSE 1 END + late + u.c, 'a': CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END || u.a, 'r': 'u' || u.r}) AS z,
             least({'c': s.c + 2, 'a': 'D' || s.a, 'r': ' ' || s.r},
                   {'c': CASE WHEN del THEN 1000000 WHEN initial = 'u' THEN 0 ELSE 1 END + late + u.c, 'a': CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END || u.a, 'r': 'u' || u.r}) AS s,
             least({'c': u.c + 2, 'a': 'D' || u.a, 'r': ' ' || u.r},
                   {'c': CASE WHEN del THEN 1000000 WHEN initial = 'a' THEN 0 ELSE 1 END + late + p.c, 'a': CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END || p.a, 'r': 'a' || p.r}) AS u,
             least({'c': p.c + 2, 'a': 'D' || p.a, 'r': ' ' || p.r},
                   {'c': CASE WHEN del THEN 1000000 WHEN initial = 'u' THEN 0 ELSE 1 END + late + u.c, 'a': CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END || u.a, 'r': 'u' || u.r}) AS p
      FROM chart h JOIN (SELECT conv_id AS id, i AS at, initial, fault IN ('blank', 'duplicate') AS del, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM r5) q
        ON h.conv_id IS NOT DISTINCT FROM q.id AND h.i = q.at))),
best AS (SELECT conv_id, z.c AS cost, z.a AS audit, z.r AS roles FROM chart WHERE i = 0),
edits AS (SELECT conv_id, j, audit[j] AS edit, roles[j] AS given, len(replace(audit[1:j], 'I', '')) AS i
          FROM (SELECT conv_id, audit, roles, unnest(range(1, len(audit) + 1)) AS j FROM best)),
parts AS (SELECT e.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN given = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
          FROM edits e LEFT JOIN r5 ON e.conv_id IS NOT DISTINCT FROM r5.conv_id AND e.i = r5.i WHERE edit <> 'D' GROUP BY e.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN parts p ON o.conv_id IS NOT DISTINCT FROM p.conv_id
"""
