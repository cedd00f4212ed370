"""A registry of queries: name -> (spark, folder) -> DataFrame, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The stand-in domain tables in SQL.
TABLES = {
    "allele": """SELECT o_custkey AS sample_id, CAST(l_linenumber AS BIGINT) AS marker_id, CAST(l_quantity AS INT) AS value,
        l_quantity + l_discount AS size, l_extendedprice AS height, l_orderkey AS assay_id, l_returnflag AS peak_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "haplo": "SELECT sample_id, marker_id, CAST(floor(value / 10) AS INT) AS value, height FROM allele WHERE marker_id <= 3",
    "sample": """SELECT c_custkey AS sample_id, c_name AS code, c_mktsegment AS batch, r_name AS country, n_name AS level1,
        d AS collection_date, c_custkey % 2 = 0 AS passive_detection, c_acctbal < 0 AS recurrent
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "facts": "SELECT country AS set_id, a.* FROM allele a JOIN sample s ON a.sample_id = s.sample_id",
    "topped": """SELECT set_id, sample_id, marker_id, value, height FROM (
        SELECT *, max(height) OVER (PARTITION BY marker_id, sample_id) AS top FROM facts) WHERE height = top""",
    "genotype": """SELECT country AS set_id, h.sample_id, avg(CASE WHEN marker_id = 1 THEN value END) AS m1,
        avg(CASE WHEN marker_id = 2 THEN value END) AS m2, avg(CASE WHEN marker_id = 3 THEN value END) AS m3
        FROM (SELECT *, max(height) OVER (PARTITION BY marker_id, sample_id) AS top FROM haplo) h
        JOIN sample s ON h.sample_id = s.sample_id WHERE height = top GROUP BY 1, 2""",
    "coarse": "SELECT sample_id, marker_id, CAST(floor(value / 10) AS INT) AS value, height FROM allele",
    "whole7": """SELECT sample_id, m1, m2, m3, m4, m5, m6, m7 FROM (PIVOT (SELECT sample_id, marker_id, avg(value) AS v
        FROM (SELECT *, max(height) OVER (PARTITION BY marker_id, sample_id) AS top FROM coarse) WHERE height = top GROUP BY ALL)
        ON marker_id IN (1 AS m1, 2 AS m2, 3 AS m3, 4 AS m4, 5 AS m5, 6 AS m6, 7 AS m7) USING any_value(v) GROUP BY sample_id)
        WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL AND m4 IS NOT NULL AND m5 IS NOT NULL AND m6 IS NOT NULL AND m7 IS NOT NULL""",
    "whole": "SELECT * FROM genotype WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL",
    "moi": """SELECT set_id, sample_id, max(n) AS moi, count(*) FILTER (n > 1) AS multi_loci
        FROM (SELECT set_id, sample_id, marker_id, count(*) AS n FROM facts GROUP BY ALL) GROUP BY ALL""",
    "he": """SELECT set_id, marker_id, sum(c) AS n, CASE WHEN sum(c) > 1 THEN sum(c) / (sum(c) - 1) ELSE 1 END
        * (1 - sum(c * c) / (sum(c) * sum(c))) AS he
        FROM (SELECT set_id, marker_id, value, CAST(count(*) AS DOUBLE) AS c FROM topped GROUP BY ALL) GROUP BY ALL""",
    "peak": """SELECT event_id AS peak_id, user_id AS channel_id, user_id % 50 AS assay_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rtime,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 0.75 AS size, value AS height FROM events""",
}
_NEEDS = {"haplo": ("allele",), "facts": ("allele", "sample"), "topped": ("facts",), "genotype": ("haplo", "sample"), "whole": ("genotype",), "coarse": ("allele",), "whole7": ("coarse",), "moi": ("facts",), "he": ("topped",)}


def _with(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_with(_NEEDS.get(n, ())), n]:
            if x not in out:
                out.append(x)
    return out


def query(name: str, sql: str | None = None, *tables: str):
    """Register a function; `tables` are the stand-in tables that its SQL reads."""

    def add(f):
        QUERIES[name] = f
        if sql:
            head = ",\n".join(f"{t} AS ({TABLES[t]})" for t in _with(tables))
            ORACLE_SQL[name] = f"WITH {head}\n{sql}" if head else sql
        return f

    return add
