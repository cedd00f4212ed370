import heapq
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pandas as pd

from tandemlake.llm import repair

ROWS = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
RIGHT = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, output) by searching all edits in order of (cost, audit). rows: (role, fault, text)."""
    todo, seen = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, at, roles, out = heapq.heappop(todo)
        if at == len(rows) and RIGHT.fullmatch(roles):
            return cost, audit, "\n".join(out)
        # What may still come depends on the end of the roles alone.
        state = (at, roles[-1:], audit[len(audit) - 3 :] == "III")
        if state in seen or audit.endswith("III") or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add(state)
        if at < len(rows):
            role, fault, text = rows[at]
            heapq.heappush(todo, (cost + 2, audit + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                heapq.heappush(todo, (cost + late, audit + "K", at + 1, roles + (role[:1] or "?"), (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(todo, (cost + late + 1, audit + "R", at + 1, roles + r[0], (*out, f"{r}:{text}")))
        for r in ("user", "assistant"):
            heapq.heappush(todo, (cost + 5, audit + "I", at, roles + r[0], (*out, f"{r}:")))


def brute(table):
    """The query's rows by its definition."""
    groups = {}
    for conv, turn, role, text in table:
        kept = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        kept += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).hexdigest()))
        seen, rows = set(), []
        for _, role, text in kept:
            last = text.rstrip(WHITE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, fault, text))
        turns = {t for t, _, _ in kept if t is not None}
        faults = [f for _, f, _ in rows]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, whole = cheapest(rows)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha256(whole.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_parse_equals_a_search_of_all_edits():
    rng = random.Random(3)
    for _ in range(400):
        code = "".join(rng.choice("suauauaSUAX?!") for _ in range(rng.randrange(9)))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "?"), "blank" if c == "!" else "truncated" if c.isupper() else "", "t") for c in code]
        cost, audit, roles = repair.parse(code)
        assert (cost, audit) == cheapest(rows)[:2], code
        assert RIGHT.fullmatch(roles.replace(" ", "")) and len(roles) == len(audit)
        assert len(audit.replace("I", "")) == len(code)


def test_parse_of_long_conversations():
    code = "s" + "ua" * 20_000 + "!" + "ua" * 20_000
    assert repair.parse(code) == (2, "K" * 40_001 + "D" + "K" * 40_000, "s" + "ua" * 20_000 + " " + "ua" * 20_000)
    assert repair.parse("") == (0, "", "")


def test_repair_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = repair.op13_conversation_repair(spark, folder)
    assert got.columns == COLUMNS
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute(table)


def test_repair_of_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "User", "tool", "", None, "user", "assistant"]
    texts = ["Hi.", "Hi", "", " \t\n\x0b\r\x0c", None, "What?", "Yes!\n", "no end  ", "é.", "x" * 9_000 + ".", "Hi."]
    table = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randrange(1, 8))]
    table += [(None, t, "user", "No id.") for t in (None, 1, 1, 2)] + [(7_000, t, "ua"[t % 2] + "x", f"{t}.") for t in range(300)]
    table += [(8_000 + c, 3, "user", "Alone.") for c in range(40)]  # some lose their only row
    frame = spark.createDataFrame(table, ROWS).selectExpr("*", "'clash' AS cost", "1 AS audit", "2 AS digest")
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute(table)
    assert any(w[7] == "" for w in want)
    assert sorted(map(tuple, repair.op13_conversation_repair(spark, str(tmp_path)).collect()), key=str) == want
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(table, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({repair.OP13_SQL})").fetchall(), key=str) == want
    assert repair.repair_conversations(spark.createDataFrame([], ROWS)).count() == 0
