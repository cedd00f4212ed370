"""The operators as queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import AnalysisParams
from ..operators import alleles as al
from ..operators import genotype as gt
from ..operators import peaks as pk
from ..operators import popgen as pop
from ..operators import quality as ql
from ..operators import sets as st
from ..operators import signal as sg
from ..operators import store
from ..operators import summary as sm
from ..sources import exports as ex
from ..sources import tables as tb
from .registry import query

MARKERS7, MARKERS3 = [1, 2, 3, 4, 5, 6, 7], [1, 2, 3]
SETS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PARAMS = AnalysisParams(abs_threshold=20_000, rel_threshold=0.33, sample_qual_threshold=0.5, marker_qual_threshold=0.5, peak_types=("R", "A", "N"), spatial=0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Alleles with the set of their sample. Sets, the small side, are hashed, so alleles are sorted once, by what follows."""
    return tb.alleles(spark, d).join(tb.country_sets(spark, d).hint("shuffle_hash"), "sample_id")


def wide(spark: SparkSession, d: str) -> DataFrame:
    return gt.genotypes(tb.haplotype_alleles(spark, d).join(tb.country_sets(spark, d), "sample_id"), MARKERS3)


# Filters.

ROW = "sample_id, marker_id, value, size, height, assay_id"


def rows(df: DataFrame) -> DataFrame:
    return df.select(*ROW.split(", "))


query("allele_absolute", f"SELECT {ROW} FROM allele WHERE height > 50000", "allele")(lambda s, d: rows(al.absolute(tb.alleles(s, d), 50_000)))
query("allele_types", f"SELECT {ROW} FROM allele WHERE peak_type IN ('R', 'A')", "allele")(lambda s, d: rows(al.by_type(tb.alleles(s, d), ("R", "A"))))
query("allele_markers", f"SELECT {ROW} FROM allele WHERE marker_id IN (1, 3)", "allele")(lambda s, d: rows(al.by_marker(tb.alleles(s, d), (1, 3))))
query(
    "allele_relative",
    f"SELECT {ROW} FROM (SELECT *, max(height) OVER (PARTITION BY marker_id, sample_id) AS top FROM allele) WHERE height / top >= 0.33", "allele",
)(lambda s, d: rows(al.relative(tb.alleles(s, d), 0.33)))
query(
    "allele_cutoff",
    f"""SELECT {ROW} FROM (SELECT *, max(CASE WHEN rk = 2 THEN ratio END) OVER (PARTITION BY marker_id, sample_id) AS second FROM (
        SELECT *, row_number() OVER (PARTITION BY marker_id, sample_id ORDER BY ratio DESC) AS rk FROM (
        SELECT *, height / max(height) OVER (PARTITION BY marker_id, sample_id) AS ratio FROM allele) WHERE ratio >= 0.33))
        WHERE coalesce(second, 0) <= 0.8""", "allele",
)(lambda s, d: rows(al.relative(tb.alleles(s, d), 0.33, 0.8)))
query("dominant_alleles", "SELECT set_id, sample_id, marker_id, value, height FROM topped", "topped")(
    lambda s, d: al.dominant(facts(s, d)).select("set_id", "sample_id", "marker_id", "value", "height")
)
query(
    "sample_alleles",
    """SELECT sample_id, marker_id, string_agg(CAST(value AS VARCHAR), ' ' ORDER BY height DESC, value DESC) AS vals
       FROM allele WHERE peak_type IN ('R', 'A') GROUP BY ALL""", "allele",
)(lambda s, d: al.sample_alleles(tb.alleles(s, d, ("R", "A"))).select("sample_id", "marker_id", F.concat_ws(" ", F.transform("alleles", lambda a: a["value"].cast("string"))).alias("vals")))
query(
    "topk_alleles",
    """SELECT marker_id, value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY marker_id ORDER BY n DESC, value) AS INT) AS rank
       FROM (SELECT marker_id, value, count(*) AS n FROM allele GROUP BY ALL)) WHERE rank <= 3""", "allele",
)(lambda s, d: al.top_alleles(tb.alleles(s, d), 3))
query(
    "latest_revision",
    "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL",
)(lambda s, d: al.latest(tb.read(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"))

# Quality.

query(
    "sample_quality",
    """SELECT set_id, sample_id, n - present AS failed, n - present <= n - 0.9 * n AS passed
       FROM (SELECT set_id, sample_id, count(DISTINCT marker_id) AS present FROM facts GROUP BY ALL), (SELECT count(DISTINCT marker_id) AS n FROM facts)""", "facts",
)(lambda s, d: ql.sample_quality(facts(s, d), 0.9))
query(
    "marker_quality",
    """SELECT marker_id, n - present AS failed, round((n - present) / present * 100, 6) AS prop_failed_pct, (n - present) / present <= 0.1 AS passed
       FROM (SELECT marker_id, count(DISTINCT sample_id) AS present FROM facts WHERE height > 20000 GROUP BY ALL),
            (SELECT count(DISTINCT sample_id) AS n FROM facts WHERE height > 20000)""", "facts",
)(lambda s, d: rounded(ql.marker_quality(al.absolute(facts(s, d), 20_000), 0.1)))
query(
    "marker_quality_total",
    """SELECT marker_id, n - present AS failed, round((n - present) / n * 100, 6) AS prop_failed_pct, (n - present) / n <= 0.1 AS passed
       FROM (SELECT marker_id, count(DISTINCT sample_id) AS present FROM facts WHERE height > 20000 GROUP BY ALL),
            (SELECT count(DISTINCT sample_id) AS n FROM facts WHERE height > 20000)""", "facts",
)(lambda s, d: rounded(ql.marker_quality(al.absolute(facts(s, d), 20_000), 0.1, "total")))
query(
    "strict_samples",
    """SELECT a.sample_id, a.marker_id, count(*) AS n FROM (SELECT * FROM allele WHERE height > 70000) a JOIN (
       SELECT sample_id FROM (SELECT sample_id, marker_id, count(*) AS n FROM allele WHERE height > 70000 GROUP BY ALL)
       GROUP BY 1 HAVING count(*) FILTER (n > 1) <= 1) USING (sample_id) GROUP BY ALL""", "allele",
)(lambda s, d: ql.strict(al.absolute(tb.alleles(s, d), 70_000)).groupBy("sample_id", "marker_id").agg(F.count("*").alias("n")))
_PREPARED = """, kept AS (
  SELECT country AS location, a.* FROM (SELECT *, max(height) OVER (PARTITION BY marker_id, sample_id) AS top FROM allele WHERE height > 20000) a
  JOIN sample s ON a.sample_id = s.sample_id WHERE height / top >= 0.33),
good AS (SELECT location, sample_id FROM kept GROUP BY ALL HAVING count(DISTINCT marker_id) >= 0.5 * (SELECT count(DISTINCT marker_id) FROM kept)),
again AS (SELECT kept.* FROM kept SEMI JOIN good ON kept.sample_id = good.sample_id),
fine AS (SELECT marker_id FROM again GROUP BY ALL HAVING ((SELECT count(DISTINCT sample_id) FROM again) - count(DISTINCT sample_id)) / count(DISTINCT sample_id) <= 0.5)
"""


def prepared(s: SparkSession, d: str, params: AnalysisParams = PARAMS):
    members = st.all_samples(tb.samples(s, d)).select(F.lit(0).alias("set_id"), "sample_id")
    return ql.prepare(tb.alleles(s, d), members, tb.samples(s, d), params)


@query("prepared_alleles", _PREPARED + f"SELECT location, {ROW} FROM again WHERE marker_id IN (SELECT marker_id FROM fine)", "allele", "sample")
def prepared_alleles(s, d):
    kept, sets = prepared(s, d)
    labels = sets.select("set_id", F.col("label").alias("location")).distinct()
    return kept.join(F.broadcast(labels), "set_id").select("location", *ROW.split(", "))


# Sample sets.

IDS = "SELECT DISTINCT sample_id FROM sample WHERE NOT recurrent AND "
BY = {
    "q_country": ("country = 'ASIA'", {"country": "ASIA"}),
    "q_admin": ("level1 = 'NATION_8'", {"level1": "NATION_8"}),
    "q_batch_ilike": ("batch ILIKE 'auto%'", {"batch": "auto%"}),
    "q_country_batch": ("country = 'ASIA' AND batch ILIKE 'BUILDING'", {"country": "ASIA", "batch": "BUILDING", "location": "anything"}),
}
for _name, (_sql, _fields) in BY.items():
    query(_name, IDS + _sql, "sample")(lambda s, d, f=_fields: st.select_samples(tb.samples(s, d), **f))
RANGES = {
    "q_allele_range": ("value BETWEEN 48 AND 50", "48-50"), "q_allele_ge": ("value >= 50", ">=50"), "q_allele_le": ("value <= 1", "<=1"),
    "q_allele_gt": ("value > 49", ">49"), "q_allele_lt": ("value < 2", "<2"), "q_allele_eq": ("value = 7", "7"),
}
for _name, (_sql, _text) in RANGES.items():
    query(_name, IDS + f"sample_id IN (SELECT sample_id FROM allele WHERE {_sql})", "allele", "sample")(
        lambda s, d, t=_text: st.select_samples(tb.samples(s, d), tb.alleles(s, d), allele=t)
    )
query("q_marker_and_allele", IDS + "sample_id IN (SELECT sample_id FROM allele WHERE value >= 45 AND marker_id = 2)", "allele", "sample")(
    lambda s, d: st.select_samples(tb.samples(s, d), tb.alleles(s, d), allele=">=45", marker=2)
)
query("q_all", "SELECT DISTINCT sample_id FROM sample", "sample")(lambda s, d: st.all_samples(tb.samples(s, d)))


def asia(s, d):
    return st.select_samples(tb.samples(s, d), country="ASIA")


def autos(s, d):
    return st.select_samples(tb.samples(s, d), batch="AUTOMOBILE")


A, B = IDS + "country = 'ASIA'", IDS + "batch = 'AUTOMOBILE'"
query("q_union", f"{A} UNION {B}", "sample")(lambda s, d: st.union(asia(s, d), autos(s, d)))
query("q_intersect", f"{A} INTERSECT {B}", "sample")(lambda s, d: st.intersection(asia(s, d), autos(s, d)))
query("q_xor", f"({A} UNION {B}) EXCEPT ({A} INTERSECT {B})", "sample")(lambda s, d: st.exclusive(asia(s, d), autos(s, d)))
query("q_not", f"SELECT sample_id FROM sample EXCEPT {A}", "sample")(lambda s, d: st.complement(asia(s, d), tb.samples(s, d)))
query("q_saved_set", A, "sample")(lambda s, d: st.saved_set(st.save_set(asia(s, d), 3, 1).union(st.save_set(autos(s, d), 3, 2)), 3, 1))
query(
    "q_labelled_sets",
    f"""SELECT label, colour, count(*) AS n FROM (SELECT sample_id, 'Asia' AS label, 'red' AS colour FROM ({A}) UNION ALL
        SELECT sample_id, 'Europe', 'green' FROM ({IDS} country = 'EUROPE')) SEMI JOIN ({B}) b USING (sample_id) GROUP BY ALL""", "sample",
)(lambda s, d: _labelled(s, d))


_MORE = "SELECT DISTINCT sample_id FROM allele WHERE"
_HIGH = f"({IDS} country = 'EUROPE' INTERSECT {_MORE} value BETWEEN 20 AND 30 AND marker_id IN (2, 5))"
_NESTED = f"((({A}) UNION ({B})) EXCEPT (({A}) INTERSECT ({B})))"
_OUTSIDE = f"(SELECT sample_id FROM sample EXCEPT ({_NESTED} UNION {_HIGH}))"


def _trees(s: SparkSession, d: str) -> dict:
    """Nested expressions of the sets of the other queries, one of them a saved set."""
    a, b, high = {"country": "ASIA"}, {"batch": "auto%"}, {"country": "EUROPE", "allele": "20-30", "marker": [2, 5]}
    nested = ("exclusive", a, b)
    saved = st.saved_set(st.save_set(asia(s, d), 3, 1), 3, 1)
    return {
        "nested": nested, "high": high, "outside": ("not", ("union", nested, high)), "saved": ("intersection", saved, ("not", b), ("all",)),
        "none": ("intersection", ("not", nested), ("none",)), "three": ("intersection", ("union", a, high), ("not", ("not", ("union", high, b)))),
    }


query("q_expression", _OUTSIDE, "sample", "allele")(lambda s, d: st.select_expression(_trees(s, d)["outside"], tb.samples(s, d), tb.alleles(s, d)))
query(
    "q_expression_sets",
    f"""SELECT 0 AS set_id, 'nested' AS label, sample_id FROM {_NESTED} UNION ALL SELECT 1, 'high', sample_id FROM {_HIGH} UNION ALL SELECT 2, 'outside', sample_id FROM {_OUTSIDE}
    UNION ALL SELECT 3, 'saved', sample_id FROM (({A}) EXCEPT ({B})) UNION ALL SELECT 5, 'three', sample_id FROM ((({A}) UNION {_HIGH}) INTERSECT ({_HIGH} UNION ({B})))""", "sample", "allele",
)(lambda s, d: _expressions(s, d))


def _expressions(s, d):
    members, dim = st.expression_sets(_trees(s, d), tb.samples(s, d), tb.alleles(s, d))
    return members.join(F.broadcast(dim), "set_id").select("set_id", "label", "sample_id")


def _labelled(s, d):
    members, dim = st.labelled({"Asia ": asia(s, d), " Europe": st.select_samples(tb.samples(s, d), country="EUROPE")}, autos(s, d))
    return members.join(F.broadcast(dim), "set_id").groupBy("label", "colour").agg(F.count("*").alias("n"))


query(
    "q_visibility_page",
    "SELECT sample_id, code FROM sample WHERE passive_detection OR batch IN ('BUILDING', 'MACHINERY') ORDER BY code LIMIT 300 OFFSET 300", "sample",
)(lambda s, d: st.page(st.visible(tb.samples(s, d), ("BUILDING", "MACHINERY"), "passive_detection", "batch"), "code", 1).select("sample_id", "code"))
query("q_by_code", "SELECT sample_id, code FROM sample WHERE lower(code) = lower('customer#000000007')", "sample")(
    lambda s, d: st.by_code(tb.samples(s, d), "customer#000000007").select("sample_id", "code")
)
query("location_grep", "SELECT DISTINCT country, level1 FROM sample WHERE contains(country, '_1') OR contains(level1, '_1')", "sample")(
    lambda s, d: st.find_locations(tb.samples(s, d).select("country", "level1").distinct(), "_1")
)
query("location_render", "SELECT sample_id, country || ' / ' || level1 AS place, country AS top, '' AS none FROM sample", "sample")(
    lambda s, d: tb.samples(s, d).select("sample_id", scalar.location(1).alias("place"), scalar.location(0).alias("top"), scalar.location(-1).alias("none"))
)


def split(s, d, **k):
    members = st.all_samples(tb.samples(s, d)).select(F.lit(0).alias("set_id"), "sample_id")
    return st.differentiate(members, tb.samples(s, d).filter("collection_date IS NOT NULL"), **k)


query(
    "quarterly_groups",
    """SELECT location, time, count(*) AS n FROM (SELECT country || ' / ' || level1 AS location, CAST(year(collection_date) AS VARCHAR) || ' ' ||
       CASE WHEN month(collection_date) >= 9 THEN 'Q4' WHEN month(collection_date) >= 6 THEN 'Q3' WHEN month(collection_date) >= 3 THEN 'Q2' ELSE 'Q1' END AS time
       FROM sample WHERE collection_date IS NOT NULL) GROUP BY ALL""", "sample",
)(lambda s, d: split(s, d, spatial=1, temporal=3).groupBy("location", "time").agg(F.count("*").alias("n")))
query(
    "detection_groups",
    """SELECT label, count(*) AS n FROM (SELECT country || ' | ' || year(collection_date) || CASE WHEN passive_detection THEN ' PD' ELSE ' AD' END AS label
       FROM sample WHERE collection_date IS NOT NULL) GROUP BY ALL""", "sample",
)(lambda s, d: split(s, d, spatial=0, temporal=1, detection=True).groupBy("label").agg(F.count("*").alias("n")))
query("main_country", "SELECT country, count(*) AS n FROM sample GROUP BY ALL ORDER BY n DESC, country DESC LIMIT 1", "sample")(
    lambda s, d: st.main_country(st.all_samples(tb.samples(s, d)), tb.samples(s, d).select("sample_id", "country"))
)
query("by_location", "SELECT country || ' / ' || level1 AS location, count(*) AS n FROM sample GROUP BY ALL", "sample")(
    lambda s, d: sm.by_location(tb.samples(s, d).select(scalar.location(1).alias("location")))
)
query("by_year_location", "SELECT CAST(year(collection_date) AS INT) AS year, country AS location, count(*) AS n FROM sample GROUP BY ALL", "sample")(
    lambda s, d: sm.by_year(tb.samples(s, d).select(F.year("collection_date").alias("year"), scalar.location(0).alias("location")))
)

# Summaries.

query(
    "he_by_marker",
    """SELECT marker_id, CAST(sum(c) AS BIGINT) AS n, round(sum(c) / (sum(c) - 1) * (1 - sum(c * c) / (sum(c) * sum(c))), 6) AS he
       FROM (SELECT marker_id, value, CAST(count(*) AS DOUBLE) AS c FROM topped WHERE height > 20000 GROUP BY ALL) GROUP BY ALL""", "topped",
)(lambda s, d: rounded(sm.heterozygosity(al.dominant(al.absolute(tb.alleles(s, d), 20_000)))))
query(
    "he_by_samples",
    """SELECT marker_id, samples, round(CAST(samples AS DOUBLE) / (samples - 1) * (1 - squares / (n * n)), 6) AS he FROM
       (SELECT marker_id, CAST(sum(c) AS DOUBLE) AS n, sum(CAST(c AS DOUBLE) * c) AS squares FROM (SELECT marker_id, value, count(*) AS c FROM allele GROUP BY ALL) GROUP BY ALL)
       JOIN (SELECT marker_id, count(DISTINCT sample_id) AS samples FROM allele GROUP BY ALL) USING (marker_id)""", "allele",
)(lambda s, d: rounded(sm.heterozygosity_by_samples(tb.alleles(s, d))))
query("he_mean_by_set", "SELECT set_id, round(avg(he), 6) AS he, round(stddev_pop(he), 6) AS sd, count(*) AS markers FROM he GROUP BY ALL", "he")(
    lambda s, d: rounded(sm.mean_heterozygosity(facts(s, d)))
)
query(
    "he_pivot",
    "SELECT marker_id, " + ", ".join(f"round(max(CASE WHEN set_id = '{x}' THEN he END), 6) AS \"{x}\"" for x in SETS) + " FROM he GROUP BY ALL", "he",
)(lambda s, d: rounded(sm.he_table(facts(s, d), SETS)))
query(
    "kruskal_h",
    """, r AS (SELECT set_id, rank() OVER (ORDER BY he) + (count(*) OVER (PARTITION BY he) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY he) AS t FROM he),
    p AS (SELECT set_id, sum(r) AS s, count(*) AS c, sum(t * t - 1) AS ties FROM r GROUP BY ALL),
    g AS (SELECT sum(s * s / c) AS a, CAST(sum(c) AS DOUBLE) AS n, sum(ties) AS ties, count(*) AS k FROM p)
    SELECT round((12.0 / (n * (n + 1)) * a - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, k - 1 AS df FROM g""", "he",
)(lambda s, d: rounded(sm.kruskal(_he_rows(s, d), "set_id", "he")))


def _he_rows(s, d):
    return sm.heterozygosity(al.dominant(facts(s, d), ("set_id", "marker_id", "sample_id")), ("set_id", "marker_id"))


query(
    "wilcoxon_w",
    """, d AS (SELECT a.he - b.he AS d FROM he a JOIN he b USING (marker_id) WHERE a.set_id = 'ASIA' AND b.set_id = 'EUROPE' AND a.he <> b.he),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
    SELECT round(least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)), 6) AS w, count(*) AS n FROM r""", "he",
)(lambda s, d: rounded(sm.wilcoxon(sm.he_table(facts(s, d), SETS), "ASIA", "EUROPE")))
query(
    "allele_summary",
    """, x AS (SELECT marker_id, value, count(*) AS n, round(sum(height), 2) AS sum_height, round(min(size), 6) AS min_size, round(max(size), 6) AS max_size,
       round(max(size) - min(size), 6) AS delta, round(sum(size), 2) AS sum_size, count(DISTINCT sample_id) AS samples,
       round(count(*) / any_value(total), 6) AS freq
       FROM (SELECT *, count(*) OVER (PARTITION BY marker_id) AS total FROM allele) GROUP BY marker_id, value)
    SELECT *, CASE WHEN lead(value) OVER o IS NULL THEN true ELSE coalesce(value - lag(value) OVER o > 1, true) AND lead(value) OVER o - value > 1 END AS ok
    FROM x WINDOW o AS (PARTITION BY marker_id ORDER BY value)""", "allele",
)(lambda s, d: rounded(_sums(sm.allele_summary(tb.alleles(s, d)))))


def _sums(df):
    """Means back to sums: they have two exact digits, so rounding never meets a tie."""
    for x in ("height", "size"):
        df = df.withColumn(f"sum_{x}", F.round(F.col(f"mean_{x}") * F.col("n"), 2)).drop(f"mean_{x}")
    return df


query(
    "allele_summary_by_set",
    """SELECT set_id, marker_id, value, count(*) AS n, round(count(*) / any_value(total), 6) AS freq
       FROM (SELECT *, count(*) OVER (PARTITION BY set_id, marker_id) AS total FROM facts) GROUP BY set_id, marker_id, value""", "facts",
)(lambda s, d: rounded(sm.allele_summary(facts(s, d), ("set_id",)).select("set_id", "marker_id", "value", "n", "freq")))
query(
    "delta_status",
    """SELECT marker_id, value, CASE WHEN nxt IS NULL THEN true ELSE coalesce(value - prv > 1, true) AND nxt - value > 1 END AS ok FROM (
       SELECT *, lag(value) OVER (PARTITION BY marker_id ORDER BY value) AS prv, lead(value) OVER (PARTITION BY marker_id ORDER BY value) AS nxt
       FROM (SELECT DISTINCT marker_id, value FROM allele WHERE height > 90000))""", "allele",
)(lambda s, d: sm.delta_status(al.absolute(tb.alleles(s, d), 90_000).select("marker_id", "value").distinct()))
query("moi_per_sample", "SELECT sample_id, moi, multi_loci FROM moi", "moi")(lambda s, d: ql.moi_per_sample(tb.alleles(s, d)))
query(
    "moi_stats",
    """SELECT set_id, round(avg(moi), 6) AS mean, quantile_cont(moi, 0.5) AS median, min(moi) AS min, max(moi) AS max, round(stddev_pop(moi), 6) AS sd,
       round(avg(CASE WHEN moi > 1 THEN 1.0 ELSE 0 END), 6) AS prop, count(*) FILTER (moi > 1) AS n FROM moi GROUP BY ALL""", "moi",
)(lambda s, d: rounded(sm.moi_stats(facts(s, d))))
query("moi_hist", "SELECT multi_loci, count(*) AS n FROM moi GROUP BY ALL", "moi")(lambda s, d: sm.moi_histogram(tb.alleles(s, d)))
query("moi_max_hist", "SELECT moi, count(*) AS n FROM moi GROUP BY ALL", "moi")(lambda s, d: sm.moi_histogram(tb.alleles(s, d), "moi"))
query(
    "polyclonality", "SELECT set_id, marker_id, count(*) FILTER (n > 1) AS polyclonal FROM (SELECT set_id, marker_id, sample_id, count(*) AS n FROM facts GROUP BY ALL) GROUP BY ALL", "facts",
)(lambda s, d: sm.polyclonality(facts(s, d), ("set_id", "marker_id")))
query("marker_distribution", "SELECT marker_id, count(DISTINCT sample_id) AS samples FROM allele GROUP BY ALL", "allele")(lambda s, d: sm.marker_distribution(tb.alleles(s, d)))
query(
    "allele_count_matrix", "SELECT sample_id, " + ", ".join(f"count(*) FILTER (marker_id = {m}) AS m{m}" for m in MARKERS7) + " FROM allele GROUP BY ALL", "allele",
)(lambda s, d: sm.allele_matrix(tb.alleles(s, d), MARKERS7))
_MARKER = """, per AS (SELECT marker_id, sample_id, count(*) AS n FROM allele GROUP BY ALL), tops AS (SELECT marker_id, value, CAST(count(*) AS DOUBLE) AS c FROM topped GROUP BY ALL),
hets AS (SELECT marker_id, sum(c) / (sum(c) - 1) * (1 - sum(c * c) / (sum(c) * sum(c))) AS he FROM tops GROUP BY ALL),
ms AS (SELECT marker_id, avg(n) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS min, max(n) AS max, stddev_pop(n) AS sd, count(*) FILTER (n > 1) AS polyclonal, count(*) AS samples FROM per GROUP BY ALL)
"""
query(
    "marker_summary",
    _MARKER + """SELECT marker_id, round(mean, 6) AS mean, median, min, max, round(sd, 6) AS sd, polyclonal, samples, u AS "unique", round(he, 6) AS he
       FROM ms JOIN hets USING (marker_id) JOIN (SELECT marker_id, count(DISTINCT value) AS u FROM allele GROUP BY ALL) USING (marker_id)""", "topped",
)(lambda s, d: rounded(sm.marker_summary(tb.alleles(s, d))))
query(
    "clonality_cumulative",
    _MARKER + """, rk AS (SELECT marker_id, row_number() OVER (ORDER BY polyclonal DESC, marker_id) AS rank FROM ms),
    f AS (SELECT sample_id, min(rank) AS rank FROM per JOIN rk USING (marker_id) WHERE n > 1 GROUP BY ALL)
    SELECT marker_id, CAST(rank AS INT) AS rank, CAST((SELECT count(*) FROM f WHERE f.rank <= rk.rank) AS BIGINT) AS cumulative FROM rk""", "topped",
)(lambda s, d: sm.cumulative_clonality(tb.alleles(s, d), "polyclonal"))
query(
    "sample_summary",
    """SELECT set_id, count(*) AS samples, round(avg(moi), 6) AS mean, count(*) FILTER (moi > 1) AS n, round(any_value(h), 6) AS he
       FROM moi JOIN (SELECT set_id, avg(he) AS h FROM he GROUP BY ALL) USING (set_id) GROUP BY ALL""", "moi", "he",
)(lambda s, d: rounded(sm.sample_summary(facts(s, d)).select("set_id", "samples", "mean", "n", "he")))
query(
    "adjust_bins",
    """SELECT CAST(b.marker_id AS BIGINT) AS marker_id, CAST(b.tag AS INT) AS tag, coalesce(m, b.tag + 0.0) AS pos FROM
       (SELECT marker_id, tag FROM range(1, 8) r(marker_id), range(0, 61, 5) t(tag)) b LEFT JOIN
       (SELECT marker_id, value, round(avg(size), 1) AS m FROM allele GROUP BY ALL) a ON a.marker_id = b.marker_id AND a.value = b.tag""", "allele",
)(lambda s, d: sm.adjusted_bins(tb.alleles(s, d), _bins(s)))


def _bins(s):
    marker = s.range(1, 8).select(F.col("id").alias("marker_id"), F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(5))).alias("tag"))
    return marker.select("marker_id", "tag", F.col("tag").cast("double").alias("pos"))


query(
    "small_n_flags",
    "SELECT level1, count(*) AS n, CASE WHEN count(*) < 20 THEN 'red' WHEN count(*) < 30 THEN 'yellow' END AS flag FROM sample WHERE recurrent GROUP BY ALL", "sample",
)(lambda s, d: tb.samples(s, d).filter("recurrent").groupBy("level1").agg(F.count("*").alias("n")).withColumn("flag", scalar.small_sample_flag(F.col("n"))))

# Genotypes.

query("genotype_matrix", "SELECT set_id, sample_id, m1, m2, m3 FROM genotype", "genotype")(wide)
query("complete_genotypes", "SELECT set_id, sample_id, m1, m2, m3 FROM whole", "whole")(lambda s, d: gt.complete(wide(s, d), MARKERS3))
query("unique_genotypes", "SELECT m1, m2, m3, min(sample_id) AS sample_id, count(*) AS n FROM genotype GROUP BY ALL", "genotype")(
    lambda s, d: gt.unique_genotypes(wide(s, d), MARKERS3)
)
query(
    "genotype_rows",
    "SELECT sample_id, marker_id, CAST(row_number() OVER (PARTITION BY sample_id, marker_id ORDER BY height DESC, value DESC) - 1 AS INT) AS row, value, height FROM allele", "allele",
)(lambda s, d: gt.genotype_rows(tb.alleles(s, d)))
_HAP = "concat_ws(' ', CAST(CAST(m1 AS INT) AS VARCHAR), CAST(CAST(m2 AS INT) AS VARCHAR), CAST(CAST(m3 AS INT) AS VARCHAR))"
query(
    "haplotype_freq",
    f"""SELECT haplotype, freq, first_sample, CAST(CASE WHEN freq = 1 THEN 0 ELSE row_number() OVER (PARTITION BY freq > 1 ORDER BY first_sample) END AS INT) AS hap_id
        FROM (SELECT {_HAP} AS haplotype, count(*) AS freq, min(sample_id) AS first_sample FROM whole GROUP BY ALL)""", "whole",
)(lambda s, d: gt.haplotypes(wide(s, d), MARKERS3))
query("haplotype_by_set", f"SELECT set_id, {_HAP} AS haplotype, count(*) AS n FROM whole GROUP BY ALL", "whole")(lambda s, d: gt.haplotypes_by_set(wide(s, d), MARKERS3))
query(
    "pairwise_distance",
    """, g AS (SELECT * FROM whole WHERE sample_id IN (SELECT sample_id FROM sample WHERE NOT recurrent AND level1 = 'NATION_8'))
    SELECT a.sample_id AS i, b.sample_id AS j, CAST(a.m1 <> b.m1 AS INT) + CAST(a.m2 <> b.m2 AS INT) + CAST(a.m3 <> b.m3 AS INT) AS d,
      round((CAST(a.m1 <> b.m1 AS INT) + CAST(a.m2 <> b.m2 AS INT) + CAST(a.m3 <> b.m3 AS INT)) / 3, 6) AS d_norm
    FROM g a JOIN g b ON a.sample_id < b.sample_id""", "whole",
)(lambda s, d: rounded(gt.pairwise_distance(wide(s, d).join(st.select_samples(tb.samples(s, d), level1="NATION_8"), "sample_id", "left_semi"), MARKERS3)))
# The distances of all samples: pairs of distinct genotypes and the samples of each.
_KINDS = ", k AS (SELECT m1, m2, m3, min(sample_id) AS id, count(*) AS n FROM whole GROUP BY ALL)"
query(
    "genotype_pairs",
    _KINDS + """ SELECT a.id AS i, b.id AS j, a.n AS n_i, b.n AS n_j, CAST(a.m1 <> b.m1 AS INT) + CAST(a.m2 <> b.m2 AS INT) + CAST(a.m3 <> b.m3 AS INT) AS d,
      round((CAST(a.m1 <> b.m1 AS INT) + CAST(a.m2 <> b.m2 AS INT) + CAST(a.m3 <> b.m3 AS INT)) / 3, 6) AS d_norm FROM k a JOIN k b ON a.id < b.id""", "whole",
)(lambda s, d: rounded(gt.genotype_pairs(wide(s, d), MARKERS3)))
query("genotype_members", _KINDS + " SELECT sample_id, id AS genotype FROM whole JOIN k USING (m1, m2, m3)", "whole")(lambda s, d: gt.genotype_members(wide(s, d), MARKERS3))
query(
    "mismatch_hist",
    """SELECT CAST(a.m1 <> b.m1 AS INT) + CAST(a.m2 <> b.m2 AS INT) + CAST(a.m3 <> b.m3 AS INT) AS d,
       round(count(*) / sum(count(*)) OVER (), 6) AS share FROM whole a JOIN whole b ON a.sample_id <= b.sample_id GROUP BY ALL""", "whole",
)(lambda s, d: rounded(gt.mismatch_histogram(wide(s, d), MARKERS3)))
_FST = """, mm AS (SELECT a.set_id AS i, b.set_id AS j, CAST(sum(CAST(a.m1 <> b.m1 AS INT) + CAST(a.m2 <> b.m2 AS INT) + CAST(a.m3 <> b.m3 AS INT)) AS DOUBLE) AS s
  FROM {0} a, {0} b GROUP BY ALL), sz AS (SELECT set_id, CAST(count(*) AS DOUBLE) AS n FROM {0} GROUP BY ALL),
q AS (SELECT x.i, x.j, a.n AS ni, b.n AS nj, p.s / (2 * a.n) + r.s / (2 * b.n) AS w, (p.s + r.s + 2 * x.s) / (2 * (a.n + b.n)) AS t
  FROM mm x JOIN sz a ON a.set_id = x.i JOIN sz b ON b.set_id = x.j JOIN mm p ON p.i = x.i AND p.j = x.i JOIN mm r ON r.i = x.j AND r.j = x.j WHERE x.i < x.j),
v AS (SELECT i, j, w / (ni + nj - 2) AS sb, (t - w - w / (ni + nj - 2)) / (ni + nj - (ni * ni + nj * nj) / (ni + nj)) AS sa FROM q)
"""
query("fst_pairwise", _FST.format("whole") + "SELECT i AS set_i, j AS set_j, round(sa / (sa + sb), 6) AS fst FROM v", "whole")(
    lambda s, d: rounded(pop.fst(wide(s, d), MARKERS3))
)
_OWN = ", own AS (SELECT set_id, sample_id, " + ", ".join(f"{{i}} * 1000 + m{m} AS m{m}" for m in MARKERS3) + " FROM whole)"
_OWN = _OWN.replace("{i}", "CASE set_id " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(SETS, 1)) + " END")
query("fst_max", _OWN + _FST.format("own") + "SELECT i AS set_i, j AS set_j, round(sa / (sa + sb), 6) AS fst FROM v", "whole")(
    lambda s, d: rounded(pop.fst(pop.recode_private(wide(s, d), MARKERS3, SETS), MARKERS3))
)


_TWO = _FST.format("own").replace(", mm AS", ", mm2 AS").replace(", sz AS", ", sz2 AS").replace("\nq AS", "\nq2 AS").replace("\nv AS", "\nv2 AS")
_TWO = _TWO.replace("FROM mm x JOIN sz a", "FROM mm2 x JOIN sz2 a").replace("JOIN sz b", "JOIN sz2 b").replace("JOIN mm p", "JOIN mm2 p").replace("JOIN mm r", "JOIN mm2 r").replace("FROM q)", "FROM q2)")


@query(
    "fst_standardized",
    _OWN + _FST.format("whole") + _TWO + "SELECT v.i AS set_i, v.j AS set_j, round(v.sa / (v.sa + v.sb) / (v2.sa / (v2.sa + v2.sb)), 6) AS fst_std FROM v JOIN v2 ON v.i = v2.i AND v.j = v2.j", "whole",
)
def fst_standardized(s, d):
    return rounded(pop.fst_standardized(wide(s, d), MARKERS3))


query(
    "ld_index",
    """, pr AS (SELECT a.set_id, CAST(a.m1 <> b.m1 AS INT) + CAST(a.m2 <> b.m2 AS INT) + CAST(a.m3 <> b.m3 AS INT) AS d FROM whole a JOIN whole b ON a.set_id = b.set_id AND a.sample_id < b.sample_id),
    vd AS (SELECT set_id, var_pop(d) AS vd FROM pr GROUP BY ALL), n AS (SELECT set_id, CAST(count(*) AS DOUBLE) AS n FROM whole GROUP BY ALL),
    l AS (SELECT set_id, 1 AS k, m1 AS v FROM whole UNION ALL SELECT set_id, 2, m2 FROM whole UNION ALL SELECT set_id, 3, m3 FROM whole),
    h AS (SELECT set_id, k, sum(c) / (sum(c) - 1) * (1 - sum(c * c) / (sum(c) * sum(c))) AS h FROM (SELECT set_id, k, v, CAST(count(*) AS DOUBLE) AS c FROM l GROUP BY ALL) GROUP BY ALL),
    ve AS (SELECT set_id, sum(h * (1 - h)) AS ve FROM h GROUP BY ALL)
    SELECT set_id, CAST(n AS BIGINT) AS n, round((vd / ve - 1) / 2, 6) AS ia FROM vd JOIN ve USING (set_id) JOIN n USING (set_id)""", "whole",
)(lambda s, d: rounded(pop.linkage(wide(s, d), MARKERS3)))
query("ld_pvalue")(lambda s, d: pop.linkage_pvalue(wide(s, d), MARKERS3))
query("pca")(lambda s, d: rounded(pop.principal_components(gt.genotypes(tb.alleles(s, d).withColumn("set_id", F.lit(0)), MARKERS7), [f"m{m}" for m in MARKERS7])))
query("nj_tree")(lambda s, d: rounded(pop.set_tree(wide(s, d), MARKERS3)))

# Peaks and traces.

def wide7(spark: SparkSession, d: str) -> DataFrame:
    """Complete coarse genotypes of all markers, without sets."""
    return gt.complete(gt.genotypes(tb.coarse_alleles(spark, d), MARKERS7, keys=("sample_id",)), MARKERS7)


def _differing(a: str, b: str) -> str:
    return " + ".join(f"({a}.m{m} <> {b}.m{m})::INT" for m in MARKERS7)


_DISTINCT7 = ", g AS (SELECT m1, m2, m3, m4, m5, m6, m7, min(sample_id) AS first_sample, count(*) AS n FROM whole7 GROUP BY ALL)"
for _d in (1, 2):
    query(
        f"genotype_neighbours_{_d}",
        f"""{_DISTINCT7}, p AS (SELECT x.first_sample, x.n, y.n AS c, {_differing("x", "y")} AS d FROM g x, g y)
        SELECT first_sample, n, {", ".join(f"coalesce(sum(c) FILTER (d = {j}), 0)::BIGINT AS at_{j}" for j in range(1, _d + 1))},
        coalesce(sum(c) FILTER (d BETWEEN 1 AND {_d}), 0)::BIGINT AS near FROM p GROUP BY ALL""", "whole7",
    )(lambda s, d, r=_d: gt.genotype_neighbours(wide7(s, d), MARKERS7, r))
query(
    "genotype_classes",
    f"""{_DISTINCT7}, l AS (SELECT x.first_sample AS a, y.first_sample AS b FROM g x JOIN g y ON {_differing("x", "y")} <= 1),
    t AS (WITH RECURSIVE r AS (SELECT first_sample AS a, first_sample AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a, min(b) AS class_id FROM r GROUP BY a),
    z AS (SELECT class_id, sum(n)::BIGINT AS class_size FROM t JOIN g ON a = first_sample GROUP BY ALL)
    SELECT sample_id, class_id, class_size FROM whole7 JOIN g USING (m1, m2, m3, m4, m5, m6, m7) JOIN t ON first_sample = a JOIN z USING (class_id)""", "whole7",
)(lambda s, d: gt.genotype_classes(wide7(s, d), MARKERS7, 1))


query(
    "stutter",
    """SELECT peak_id, CASE WHEN (size - lag(size) OVER w < 1.25 AND lag(height) OVER w > height) OR (lead(size) OVER w - size < 1.25 AND lead(height) OVER w > height)
       THEN 'peak-stutter' ELSE 'peak-called' END AS peak_type FROM peak WINDOW w AS (PARTITION BY channel_id ORDER BY size, peak_id)""", "peak",
)(lambda s, d: pk.stutter(tb.peaks(s, d)).select("peak_id", "peak_type"))
query(
    "overlap",
    """, e AS (SELECT *, rtime - 1 AS b, rtime + 1 + peak_id % 3 AS e FROM peak)
    SELECT DISTINCT x.peak_id FROM e x JOIN e y ON x.assay_id = y.assay_id AND x.channel_id <> y.channel_id AND x.b < y.e AND y.b < x.e AND x.height < y.height""", "peak",
)(lambda s, d: pk.overlaps(tb.peaks(s, d).withColumn("brtime", F.col("rtime") - 1).withColumn("ertime", F.col("rtime") + 1 + F.col("peak_id") % 3)))
query(
    "overlap_wide",
    """, e AS (SELECT *, rtime - 1 AS b, rtime + CASE WHEN peak_id % 1000 = 7 THEN 1000000 ELSE 1 + peak_id % 40 END AS e FROM peak)
    SELECT DISTINCT x.peak_id FROM e x JOIN e y ON x.assay_id = y.assay_id AND x.channel_id <> y.channel_id AND x.b < y.e AND y.b < x.e AND x.height < y.height""", "peak",
)(lambda s, d: pk.overlaps(tb.peaks(s, d).withColumn("brtime", F.col("rtime") - 1).withColumn("ertime", F.col("rtime") + F.when(F.col("peak_id") % 1000 == 7, 1_000_000).otherwise(1 + F.col("peak_id") % 40))))
query(
    "band_overlap",
    "SELECT DISTINCT x.peak_id FROM peak x JOIN peak y ON x.assay_id = y.assay_id AND x.channel_id <> y.channel_id AND abs(x.size - y.size) < 1.25 AND x.height < y.height", "peak",
)(lambda s, d: pk.band_overlaps(tb.peaks(s, d)))
query(
    "nearest_bin",
    """SELECT assay_id, marker_id, round(size, 6) AS size, CASE WHEN size > 5 AND size < 45 THEN CAST(5 * (CASE WHEN least(greatest(ceil(size / 5), 1), 9) * 5 - size
       < size - greatest(floor(size / 5), 1) * 5 THEN least(ceil(size / 5), 9) ELSE greatest(floor(size / 5), 1) END) AS INT) ELSE value END AS value,
       CASE WHEN size > 5 AND size < 45 THEN 'peak-bin' ELSE peak_type END AS peak_type FROM allele""", "allele",
)(lambda s, d: rounded(pk.bin_alleles(tb.alleles(s, d), _markers(s)).select("assay_id", "marker_id", "size", "value", "peak_type")))


def _markers(s):
    bins = F.transform(F.sequence(F.lit(5), F.lit(45), F.lit(5)), lambda b: F.struct(b.cast("double").alias("pos"), b.alias("tag")))
    return s.range(1, 8).select(F.col("id").alias("marker_id"), F.lit(3).alias("repeats"), F.lit(5.0).alias("min_size"), F.lit(45.0).alias("max_size"), bins.alias("bins"))


query("peak_spacing", "SELECT channel_id, CAST(min(g) AS DOUBLE) AS min_gap, CAST(max(g) AS DOUBLE) AS max_gap FROM (SELECT channel_id, lead(size) OVER (PARTITION BY channel_id ORDER BY size) - size AS g FROM peak) GROUP BY ALL", "peak")(
    lambda s, d: pk.spacing(tb.peaks(s, d).withColumn("size", F.col("size").cast("double")))
)
query(
    "separated_peaks",
    """, o AS (SELECT channel_id, rtime, height, row_number() OVER (PARTITION BY channel_id ORDER BY rtime DESC, height DESC) AS i FROM peak),
    f AS (WITH RECURSIVE r(channel_id, i, rtime, height, done_rtime, done_height) AS (
      SELECT channel_id, i, rtime, height, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM o WHERE i = 1 UNION ALL
      SELECT r.channel_id, o.i, CASE WHEN r.rtime - o.rtime > 3 OR r.height <= o.height THEN o.rtime ELSE r.rtime END,
        CASE WHEN r.rtime - o.rtime > 3 OR r.height <= o.height THEN o.height ELSE r.height END,
        CASE WHEN r.rtime - o.rtime > 3 THEN r.rtime END, CASE WHEN r.rtime - o.rtime > 3 THEN r.height END
      FROM r JOIN o ON o.channel_id = r.channel_id AND o.i = r.i + 1) SELECT * FROM r)
    SELECT channel_id, CAST(done_rtime AS INT) AS rtime, done_height AS height FROM f WHERE done_rtime IS NOT NULL UNION ALL
    SELECT channel_id, CAST(arg_max(rtime, i) AS INT), arg_max(height, i) FROM f GROUP BY channel_id""", "peak",
)(lambda s, d: pk.separated(tb.peaks(s, d), 3))
query(
    "overlap_report",
    """, p AS (SELECT sample_id AS channel_id, height, CASE peak_type WHEN 'R' THEN 'peak-overlap' ELSE 'peak-bin' END AS t FROM allele),
    q AS (SELECT *, max(CASE WHEN t = 'peak-bin' THEN height END) OVER (PARTITION BY channel_id) AS top FROM p)
    SELECT channel_id, max(height) FILTER (t = 'peak-overlap') AS overlap, min(height) FILTER (t = 'peak-bin' AND height > 0.33 * top) AS lowest
    FROM q GROUP BY ALL HAVING max(height) FILTER (t = 'peak-overlap') > min(height) FILTER (t = 'peak-bin' AND height > 0.33 * top)""", "allele",
)(lambda s, d: pk.overlap_report(tb.alleles(s, d).select(F.col("sample_id").alias("channel_id"), "height", F.when(F.col("peak_type") == "R", "peak-overlap").otherwise("peak-bin").alias("peak_type"))))
query(
    "score_ladder",
    """SELECT event_id, round(1 - (CASE WHEN value <= 0 THEN 0.25 ELSE 0 END) - (CASE WHEN value > 50 THEN 0.05 ELSE 0 END) - (CASE WHEN value > 255 THEN 0.1 ELSE 0 END)
       - (CASE WHEN value > 1024 THEN 0.1 ELSE 0 END) - (CASE WHEN 36 - user_id % 40 > 0 THEN 0.025 * (36 - user_id % 40 - 1) ELSE 0 END), 6) AS score FROM events""",
)(lambda s, d: tb.read(s, d, "events").select("event_id", F.round(scalar.ladder_score(F.col("value"), F.col("user_id") % 40, F.lit(36)), 6).alias("score")))
query(
    "wavelength_rgb",
    """WITH w AS (SELECT p_partkey AS id, CAST(370 + p_partkey % 421 AS DOUBLE) AS x FROM part),
    c AS (SELECT id, x, CASE WHEN x >= 380 AND x < 440 THEN (440 - x) / 60 WHEN x >= 510 AND x < 580 THEN (x - 510) / 70 WHEN x >= 580 AND x <= 780 THEN 1 ELSE 0 END AS r,
      CASE WHEN x >= 440 AND x < 490 THEN (x - 440) / 50 WHEN x >= 490 AND x < 580 THEN 1 WHEN x >= 580 AND x < 645 THEN (645 - x) / 65 ELSE 0 END AS g,
      CASE WHEN x >= 380 AND x < 490 THEN 1 WHEN x >= 490 AND x < 510 THEN (510 - x) / 20 ELSE 0 END AS b,
      CASE WHEN x >= 380 AND x < 420 THEN 0.3 + 0.7 * (x - 380) / 40 WHEN x >= 420 AND x < 701 THEN 1 WHEN x >= 701 AND x <= 780 THEN 0.3 + 0.7 * (780 - x) / 80 ELSE 0 END AS f FROM w)
    SELECT id, concat_ws(' ', CAST(CAST(round(255 * pow(r * f, 0.8)) AS INT) AS VARCHAR), CAST(CAST(round(255 * pow(g * f, 0.8)) AS INT) AS VARCHAR),
      CAST(CAST(round(255 * pow(b * f, 0.8)) AS INT) AS VARCHAR)) AS rgb FROM c""",
)(lambda s, d: tb.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", scalar.wavelength_rgb((370 + F.col("p_partkey") % 421).cast("double"), F.lit(255)).cast("array<string>")).alias("rgb")))
query(
    "channel_stats",
    """SELECT vec_id AS channel_id, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(min(x), 6) AS min, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS sd
       FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL""",
)(lambda s, d: rounded(sg.channel_stats(tb.traces(s, d))))
_POINTS = "p AS (SELECT vec_id AS channel_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS t, CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings)"
query(
    "tophat_baseline",
    f"""WITH {_POINTS}, e AS (SELECT *, min(y) OVER (PARTITION BY channel_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS low FROM p)
        SELECT channel_id, t, round(y - max(low) OVER (PARTITION BY channel_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS y FROM e""",
)(lambda s, d: rounded(sg.points(sg.top_hat(tb.traces(s, d), 2))))
query(
    "local_maxima",
    f"WITH {_POINTS} SELECT channel_id, t, round(y, 6) AS y FROM (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM p WINDOW w AS (PARTITION BY channel_id ORDER BY t)) WHERE y > a AND y > b AND y > 0.1",
)(lambda s, d: rounded(sg.local_maxima(tb.traces(s, d), 0.1)))


def _weighted_sql(weights: list[float]) -> str:
    """Moving sums over lists, the ends mirrored through their points."""
    half = len(weights) // 2
    return f"""WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS d FROM embeddings),
    w AS (SELECT vec_id, len(d) AS n, list_concat(list_concat([d[1] - abs(x - d[1]) FOR x IN list_reverse(d[2:{half + 1}])], d),
          [d[len(d)] + abs(x - d[len(d)]) FOR x IN list_reverse(d[len(d) - {half}:len(d) - 1])]) AS wide FROM c)
    SELECT vec_id AS channel_id, CAST(t AS INT) AS t, round(list_inner_product(wide[t + 1:t + {len(weights)}], {weights}), 6) AS y
    FROM w, range(0, 64) r(t)"""


query("savgol", _weighted_sql(sg.savgol_weights()))(lambda s, d: rounded(sg.points(sg.smooth(tb.traces(s, d)))))
query("hanning_smooth", _weighted_sql(sg.hanning_weights(5)))(lambda s, d: rounded(sg.points(sg.hanning(tb.traces(s, d), 5))))
query("turning_points")(lambda s, d: sg.detect_turning_points(tb.traces(s, d), 3, 0.05))
query("cwt_peaks")(lambda s, d: rounded(sg.scan_peaks(tb.traces(s, d), sg.ScanParams(widths=(1, 2, 3, 4), min_snr=1.0))))
# Every channel is taken for the ladder channel of an assay of its own.
query("ladder_alignment")(lambda s, d: sg.align_ladders(tb.peaks(s, d).withColumn("assay_id", F.col("channel_id")), [float(x) for x in range(10, 60, 3)]).select("assay_id", F.round("score", 6).alias("score"), F.round("rss", 6).alias("rss"), "n_peaks"))

# Exports.

query("export_flat", "SELECT sample_id || ' ' || " + _HAP + " AS line FROM whole", "whole")(lambda s, d: ex.flat(gt.complete(wide(s, d), MARKERS3), MARKERS3))
query(
    "export_arlequin",
    f"SELECT set_id, CAST(row_number() OVER (ORDER BY set_id, sample_id) AS VARCHAR) || ' 1 ' || CAST(CASE set_id {' '.join(f'''WHEN '{x}' THEN {i}''' for i, x in enumerate(SETS, 1))} END AS VARCHAR) AS head FROM whole", "whole",
)(lambda s, d: ex.arlequin_rows(gt.complete(wide(s, d), MARKERS3), MARKERS3, SETS, recode=True).select("set_id", "head"))
query(
    "export_structure",
    f"SELECT sample_id || ' ' || CASE set_id {' '.join(f'''WHEN '{x}' THEN {i}''' for i, x in enumerate(SETS, 1))} END || ' ' || concat_ws(' ', " + ", ".join(f"coalesce(CAST(CAST(m{m} AS INT) AS VARCHAR), '-9')" for m in MARKERS3) + ") AS line FROM genotype", "genotype",
)(lambda s, d: ex.structure(wide(s, d), MARKERS3, SETS))

# Stored tables.


def _changes(s, d):
    """A new account balance for every third customer, and ten new customers."""
    old = tb.read(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    third = old.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    more = s.range(10_000_000, 10_000_010).select(F.col("id").alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return old, third.unionByName(more)


query(
    "merge_update",
    """SELECT c_custkey, c_name, round(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS c_acctbal FROM customer
       UNION ALL SELECT CAST(i AS BIGINT), 'new', NULL FROM range(10000000, 10000010) r(i)""",
)(lambda s, d: rounded(store.merge(*_changes(s, d), ["c_custkey"]), 2))
query("insert_missing", "SELECT CAST(i AS BIGINT) AS c_custkey, 'new' AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM range(10000000, 10000010) r(i)")(
    lambda s, d: store.insert(*_changes(s, d), ["c_custkey"])
)


@query(
    "delete_cascade",
    """SELECT 'customer' AS t, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL
       SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL
       SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)""",
)
def delete_cascade(s, d):
    tables = dict(zip(("customer", "orders", "lineitem"), tb.read(s, d, "customer", "orders", "lineitem")))
    links = [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]
    left = store.delete(tables, tables["customer"].filter("c_nationkey = 3"), links)
    parts = [left[t].agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t in tables]
    return parts[0].union(parts[1]).union(parts[2])


query(
    "set_counts",
    """SELECT country AS set_id, count(DISTINCT s.sample_id) AS members, count(DISTINCT a.sample_id) AS with_alleles, count(DISTINCT a.marker_id) AS markers
       FROM sample s LEFT JOIN (SELECT * FROM allele WHERE height > 90000) a ON a.sample_id = s.sample_id GROUP BY ALL""", "allele", "sample",
)(lambda s, d: sm.set_counts(tb.country_sets(s, d), al.absolute(tb.alleles(s, d), 90_000)))
query(
    "set_distances",
    """, l AS (SELECT set_id, 1 AS k, m1 AS v FROM whole UNION ALL SELECT set_id, 2, m2 FROM whole UNION ALL SELECT set_id, 3, m3 FROM whole)
    SELECT a.set_id AS set_i, b.set_id AS set_j, round(avg(CASE WHEN a.v <> b.v THEN 1.0 ELSE 0 END), 6) AS d
    FROM l a JOIN l b ON a.k = b.k AND a.set_id <> b.set_id GROUP BY ALL""", "whole",
)(lambda s, d: rounded(pop.set_distances(wide(s, d), MARKERS3)))
query(
    "main_country_alleles",
    """SELECT marker_id, value, count(*) AS n FROM allele WHERE sample_id IN (SELECT sample_id FROM sample WHERE country =
       (SELECT country FROM sample GROUP BY country ORDER BY count(*) DESC, country DESC LIMIT 1)) GROUP BY ALL""", "allele", "sample",
)(lambda s, d: _main_country_alleles(s, d))


def _main_country_alleles(s, d):
    """The sets of the main country taken together, as one more set."""
    people = tb.samples(s, d).select("sample_id", "country")
    top = st.main_country(st.all_samples(people), people)
    inside = people.join(F.broadcast(top.select("country")), "country").select("sample_id")
    return tb.alleles(s, d).join(inside, "sample_id", "left_semi").groupBy("marker_id", "value").agg(F.count("*").alias("n"))
