"""Reports, selectors, exports and distances as queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alleles as al
from ..operators import genotype as gt
from ..operators import popgen as pop
from ..operators import quality as ql
from ..operators import sets as st
from ..operators import store
from ..operators import summary as sm
from ..sources import exports as ex
from ..sources import tables as tb
from .queries import _HAP, _MARKER, A, B, IDS, MARKERS3, SETS, asia, autos, facts, rounded, wide
from .registry import query

NUMBER = "CASE set_id " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(SETS, 1)) + " END"


def high(s, d, height: float = 60_000):
    """The facts above a height, so that markers are missing."""
    return al.absolute(facts(s, d), height)


# Quality.

query(
    "sample_quality_report",
    """, f AS (SELECT * FROM facts WHERE height > 60000), j AS (SELECT set_id, sample_id, (SELECT count(DISTINCT marker_id) FROM f) - count(DISTINCT marker_id) AS failed,
      (SELECT count(DISTINCT marker_id) FROM f) AS n FROM f GROUP BY ALL)
    SELECT set_id, count(*) AS samples, round(avg(failed), 6) AS mean, quantile_cont(failed, 0.5) AS median, min(failed) AS min, max(failed) AS max,
      count(*) FILTER (failed > n - 0.6 * n) AS failed_samples, CAST(round_even(100.0 * count(*) FILTER (failed > n - 0.6 * n) / count(*), 0) AS INT) AS failed_pct
    FROM j GROUP BY ALL""", "facts",
)(lambda s, d: rounded(ql.sample_quality_report(high(s, d), 0.6)))
query(
    "failed_markers",
    """, f AS (SELECT * FROM facts WHERE height > 60000), o AS (SELECT set_id, sample_id, list(DISTINCT marker_id) AS own FROM f GROUP BY ALL)
    SELECT set_id, sample_id, array_to_string(list_filter((SELECT list(m ORDER BY m) FROM (SELECT DISTINCT marker_id AS m FROM f)), lambda m: NOT list_contains(own, m)), ' ') AS failed FROM o""", "facts",
)(lambda s, d: ql.failed_markers(high(s, d)).withColumn("failed", F.concat_ws(" ", F.col("failed").cast("array<string>"))))
query(
    "unique_samples",
    """, v AS (SELECT set_id, sample_id, marker_id, avg(value) AS v FROM (SELECT * FROM topped WHERE height > 50000) GROUP BY ALL),
    g AS (SELECT set_id, sample_id, string_agg(marker_id || ':' || v, ' ' ORDER BY marker_id) AS g FROM v GROUP BY ALL)
    SELECT set_id, min(sample_id) AS sample_id FROM g GROUP BY set_id, g""", "topped",
)(lambda s, d: ql.unique(al.absolute(al.dominant(facts(s, d)), 50_000)).select("set_id", "sample_id").distinct())

_JUDGED = """, n AS (SELECT count(DISTINCT marker_id) AS n FROM facts WHERE height > 60000),
  j AS (SELECT set_id, sample_id, n - count(DISTINCT marker_id) AS failed, n - count(DISTINCT marker_id) <= n - 0.6 * n AS passed FROM facts, n WHERE height > 60000 GROUP BY set_id, sample_id, n)"""
query(
    "sample_failures",
    _JUDGED + """ SELECT set_id, count(*) AS samples, round(avg(failed), 6) AS mean, round(quantile_cont(failed, 0.5), 6) AS median, min(failed) AS min, max(failed) AS max,
      count(*) FILTER (NOT passed) AS failed_samples, CAST(round_even(100.0 * count(*) FILTER (NOT passed) / count(*), 0) AS INT) AS failed_pct, count(*) FILTER (passed) AS passed_samples
      FROM j GROUP BY ROLLUP (set_id)""", "facts",
)(lambda s, d: rounded(ql.sample_failures(al.absolute(facts(s, d), 60_000), 0.6)))
query(
    "marker_failures",
    """, h AS (SELECT * FROM facts WHERE height > 60000), n AS (SELECT CAST(count(DISTINCT sample_id) AS DOUBLE) AS n FROM h),
    p AS (SELECT marker_id, count(DISTINCT sample_id) AS c FROM h GROUP BY ALL)
    SELECT 'M' || marker_id AS code, CAST(n - c AS BIGINT) AS failed, CAST(floor((n - c) / n * 100) AS INT) AS failed_pct, CASE WHEN (n - c) / c <= 0.3 THEN 'Yes' ELSE 'No' END AS included FROM p, n""", "facts",
)(lambda s, d: ql.marker_failures(al.absolute(facts(s, d), 60_000), s.range(1, 8).select(F.col("id").alias("marker_id"), F.concat(F.lit("M"), F.col("id").cast("string")).alias("code")), 0.3))

# Summaries.

query(
    "allele_status",
    """, v AS (SELECT marker_id, value, count(*) AS n FROM allele WHERE height > 90000 GROUP BY ALL),
    w AS (SELECT *, lag(value) OVER o AS prv, lead(value) OVER o AS nxt, n / sum(n) OVER (PARTITION BY marker_id) AS freq FROM v WINDOW o AS (PARTITION BY marker_id ORDER BY value))
    SELECT marker_id, value, n, round(freq, 6) AS freq, CASE WHEN nxt IS NULL THEN true ELSE coalesce(value - prv > 1, true) AND nxt - value > 1 END AS ok FROM w""", "allele",
)(lambda s, d: rounded(sm.allele_summary(al.absolute(tb.alleles(s, d), 90_000)).select("marker_id", "value", "n", "freq", "ok")))
query("allele_members", "SELECT DISTINCT marker_id, value, sample_id FROM allele WHERE height > 90000", "allele")(lambda s, d: sm.allele_members(al.absolute(tb.alleles(s, d), 90_000)))
query(
    "allele_maps",
    "SELECT set_id, marker_id, string_agg(value || '=' || n, ' ' ORDER BY value) AS counts FROM (SELECT set_id, marker_id, value, count(*) AS n FROM facts GROUP BY ALL) GROUP BY ALL", "facts",
)(lambda s, d: sm.allele_maps(facts(s, d), ("set_id",)).withColumn("counts", F.concat_ws(" ", F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))))))
query(
    "he_plain",
    "SELECT marker_id, CAST(sum(c) AS BIGINT) AS n, round(1 - sum(c * c) / (sum(c) * sum(c)), 6) AS he FROM (SELECT marker_id, value, CAST(count(*) AS DOUBLE) AS c FROM allele GROUP BY ALL) GROUP BY ALL", "allele",
)(lambda s, d: rounded(sm.heterozygosity(tb.alleles(s, d), adjust=False)))
query(
    "he_report",
    ", t AS (SELECT marker_id, " + ", ".join(f"max(CASE WHEN set_id = '{x}' THEN he END) AS \"{x}\"" for x in SETS) + " FROM he GROUP BY ALL) SELECT CAST(marker_id AS VARCHAR) AS marker, "
    + ", ".join(f'round("{x}", 6) AS "{x}"' for x in SETS) + " FROM t UNION ALL SELECT 'Mean', " + ", ".join(f'round(avg("{x}"), 6)' for x in SETS) + " FROM t UNION ALL SELECT 'StdDev', "
    + ", ".join(f'round(stddev_pop("{x}"), 6)' for x in SETS) + " FROM t", "he",
)(lambda s, d: rounded(sm.he_report(facts(s, d), SETS)[0]))
query(
    "rank_polyclonality",
    _MARKER + """, rk AS (SELECT marker_id, row_number() OVER (ORDER BY polyclonal DESC, marker_id) AS rank FROM ms),
    f AS (SELECT sample_id, min(rank) AS rank FROM per JOIN rk USING (marker_id) WHERE n > 1 GROUP BY ALL),
    c AS (SELECT marker_id, CAST(rank AS INT) AS rank, CAST((SELECT count(*) FROM f WHERE f.rank <= rk.rank) AS BIGINT) AS cumulative FROM rk)
    SELECT *, round(cumulative / max(cumulative) OVER (), 6) AS share FROM c""", "topped",
)(lambda s, d: rounded(sm.rank_polyclonality(tb.alleles(s, d), "polyclonal")))
query("loci_distribution", "SELECT set_id, multi_loci, count(*) AS n, round(avg(moi), 6) AS mean FROM moi GROUP BY ALL", "moi")(lambda s, d: rounded(sm.loci_distribution(facts(s, d))))


def _countries(s, d):
    """Levels as sets, with their countries."""
    people = tb.samples(s, d).select("sample_id", F.col("level1").alias("set_id"), "country")
    return people.select("sample_id", "set_id"), people.select("set_id", "country").distinct()


def _report(s, d):
    members, sets = _countries(s, d)
    return sm.full_sample_summary(tb.haplotype_alleles(s, d).join(members, "sample_id"), MARKERS3, sets)


_FULL = """, people AS (SELECT sample_id, level1, country FROM sample), base AS (SELECT h.*, level1, country FROM haplo h JOIN people USING (sample_id)),
top AS (SELECT country FROM (SELECT country, count(DISTINCT sample_id) AS n FROM base GROUP BY ALL) ORDER BY n DESC, country DESC LIMIT 1),
f AS (SELECT level1 AS set_id, sample_id, marker_id, value, height FROM base UNION ALL SELECT country, sample_id, marker_id, value, height FROM base WHERE country = (SELECT country FROM top)),
m AS (SELECT set_id, sample_id, max(n) AS moi, count(*) FILTER (n > 1) AS multi FROM (SELECT set_id, sample_id, marker_id, count(*) AS n FROM f GROUP BY ALL) GROUP BY ALL),
t AS (SELECT *, max(height) OVER (PARTITION BY set_id, sample_id, marker_id) AS top FROM f),
g AS (SELECT set_id, sample_id, avg(CASE WHEN marker_id = 1 THEN value END) AS m1, avg(CASE WHEN marker_id = 2 THEN value END) AS m2, avg(CASE WHEN marker_id = 3 THEN value END) AS m3
  FROM t WHERE height = top GROUP BY ALL), w AS (SELECT * FROM g WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL),
pr AS (SELECT a.set_id, CAST(a.m1 <> b.m1 AS INT) + CAST(a.m2 <> b.m2 AS INT) + CAST(a.m3 <> b.m3 AS INT) AS d FROM w a JOIN w b ON a.set_id = b.set_id AND a.sample_id < b.sample_id),
vd AS (SELECT set_id, var_pop(d) AS vd FROM pr GROUP BY ALL), l AS (SELECT set_id, 1 AS k, m1 AS v FROM w UNION ALL SELECT set_id, 2, m2 FROM w UNION ALL SELECT set_id, 3, m3 FROM w),
h AS (SELECT set_id, k, sum(c) / (sum(c) - 1) * (1 - sum(c * c) / (sum(c) * sum(c))) AS h FROM (SELECT set_id, k, v, CAST(count(*) AS DOUBLE) AS c FROM l GROUP BY ALL) GROUP BY ALL HAVING sum(c) > 1),
ve AS (SELECT set_id, sum(h * (1 - h)) AS ve FROM h GROUP BY ALL), whole_n AS (SELECT set_id, count(*) AS n FROM w GROUP BY ALL)
SELECT m.set_id, count(*) AS samples, round(avg(m.moi), 6) AS mean, any_value(whole_n.n) AS n_ld,
  CASE WHEN any_value(whole_n.n) > 2 THEN round((any_value(vd) / any_value(ve) - 1) / 2, 6) + 0.0 END AS ia,
  (SELECT count(*) FROM w JOIN m x USING (set_id, sample_id) WHERE x.multi <= 1 AND w.set_id = m.set_id) AS strict_n_ld,
  (SELECT count(*) FROM (SELECT DISTINCT set_id, m1, m2, m3 FROM w) u WHERE u.set_id = m.set_id) AS unique_n_ld
FROM m LEFT JOIN whole_n USING (set_id) LEFT JOIN vd USING (set_id) LEFT JOIN ve USING (set_id) GROUP BY m.set_id"""
query("full_sample_summary", _FULL, "haplo", "sample")(
    lambda s, d: rounded(_report(s, d).select("set_id", "samples", "mean", "n_ld", "ia", F.coalesce("strict_n_ld", F.lit(0)).alias("strict_n_ld"), F.coalesce("unique_n_ld", F.lit(0)).alias("unique_n_ld")))
)
query(
    "paired_sets",
    """, n AS (SELECT set_id, count(*) AS samples FROM moi GROUP BY ALL), x AS (SELECT set_id, count(*) AS strict_samples FROM moi WHERE multi_loci <= 1 AND set_id <> 'ASIA' GROUP BY ALL)
    SELECT set_id, samples, strict_samples FROM n FULL JOIN x USING (set_id)""", "moi",
)(lambda s, d: _paired(s, d))


def _paired(s, d):
    rows = facts(s, d)
    count = lambda r: r.groupBy("set_id").agg(F.count_distinct("sample_id").alias("samples"))
    return st.paired_sets(count(rows), count(ql.strict(rows, ("set_id", "sample_id")).filter("set_id <> 'ASIA'")))


# Sample sets.

query("q_none", "SELECT sample_id FROM sample WHERE false", "sample")(lambda s, d: st.no_samples(tb.samples(s, d)))
query(
    "selector_sets",
    f"""SELECT label, count(*) AS n FROM (SELECT 'builders' AS label, sample_id FROM sample WHERE batch = 'BUILDING' UNION
        SELECT '-', sample_id FROM sample WHERE batch = 'MACHINERY' AND code IN ('Customer#000000003', 'Customer#000000008') UNION
        SELECT '-', sample_id FROM ({A}) JOIN sample USING (sample_id) WHERE batch = 'FURNITURE') GROUP BY ALL""", "sample",
)(lambda s, d: _selected(s, d))


def _selected(s, d):
    spec = {
        "builders": [{"batch": "BUILDING"}],
        "__ALL__": [{"batch": "MACHINERY", "codes": ["Customer#000000003", "Customer#000000008"]}, {"batch": "FURNITURE", "query": "asia"}],
    }
    members, dim = st.from_selector(spec, tb.samples(s, d), {"asia": asia(s, d)})
    return members.join(F.broadcast(dim), "set_id").groupBy("label").agg(F.count("*").alias("n"))


query("saved_queries", f"SELECT CAST(3 AS INT) AS queryset_id, count(*) AS n FROM ({A}) UNION ALL SELECT 5, count(*) FROM ({B})", "sample")(
    lambda s, d: st.saved_queries(st.save_set(asia(s, d), 3, 1).union(st.save_set(autos(s, d), 5, 1)).union(st.save_set(autos(s, d), 6, 2)), 1)
)
query("last_queries", f"SELECT CAST(5 AS INT) AS queryset_id, count(*) AS n FROM ({B})", "sample")(
    lambda s, d: st.last_queries(st.save_set(asia(s, d), 3, 1).union(st.save_set(autos(s, d), 5, 1)), 1, 1)
)
query("count_before_saving", f"SELECT count(*) AS rows FROM ({IDS} country = 'ASIA')", "sample")(lambda s, d: st.save_if_any(asia(s, d), 7, 1)[1].agg(F.count("*").alias("rows")))

# Genotypes and distances.

query(
    "genotype_display",
    """SELECT sample_id, marker_id, CAST(row_number() OVER (PARTITION BY sample_id, marker_id ORDER BY height DESC, value DESC, assay_id DESC) - 1 AS INT) AS row, value, height, assay_id,
       'order ' || assay_id AS filename FROM allele""", "allele",
)(lambda s, d: gt.genotype_display(tb.alleles(s, d), tb.read(s, d, "orders").select(F.col("o_orderkey").alias("assay_id"), F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string")).alias("filename"))))
query("unique_in_sets", "SELECT set_id, min(sample_id) AS sample_id, m1, m2, m3 FROM whole GROUP BY set_id, m1, m2, m3", "whole")(lambda s, d: gt.unique_in_sets(gt.complete(wide(s, d), MARKERS3), MARKERS3))


def _dim(s):
    """Labels and colours of the sets."""
    return s.createDataFrame([(x, x.title(), c) for x, c in zip(SETS, ("red", "green", "blue", "orange", "purple"))], "set_id string, label string, colour string")


query(
    "distance_index",
    "SELECT CAST(row_number() OVER (ORDER BY set_id, sample_id) - 1 AS BIGINT) AS position, set_id, CASE set_id " + " ".join(f"WHEN '{x}' THEN '{x.title()}'" for x in SETS)
    + " END AS label, CASE set_id WHEN 'AFRICA' THEN 'red' WHEN 'AMERICA' THEN 'green' WHEN 'ASIA' THEN 'blue' WHEN 'EUROPE' THEN 'orange' ELSE 'purple' END AS colour, sample_id FROM whole", "whole",
)(lambda s, d: pop.distance_index(wide(s, d), _dim(s), MARKERS3))
query(
    "distance_slices",
    "SELECT set_id, CAST(min(p) AS BIGINT) AS start, count(*) AS n FROM (SELECT set_id, row_number() OVER (ORDER BY set_id, sample_id) - 1 AS p FROM whole) GROUP BY ALL", "whole",
)(lambda s, d: pop.distance_slices(pop.distance_index(wide(s, d), _dim(s), MARKERS3)))
query("fst_table")(lambda s, d: rounded(pop.fst_table(wide(s, d), MARKERS3, 100)))
query("distance_components")(lambda s, d: rounded(pop.distance_components(wide(s, d), MARKERS3)))


def _unlike(s, d):
    """One sample of each distinct genotype, over all sets: what a tree of samples is drawn of."""
    return gt.unique_genotypes(gt.complete(wide(s, d), MARKERS3), MARKERS3)


query("sample_tree")(lambda s, d: rounded(pop.sample_tree(_unlike(s, d), MARKERS3)))

# Exports.

query("export_by_kind", "SELECT sample_id || ' ' || " + _HAP + " AS line FROM whole", "whole")(lambda s, d: ex.export("flat", wide=gt.complete(wide(s, d), MARKERS3), markers=MARKERS3))
query(
    "export_genotypes",
    """SELECT set_id, CAST(0 AS INT) AS position, 'Label: ' || """ + "CASE set_id " + " ".join(f"WHEN '{x}' THEN '{x.title()}'" for x in SETS) + """ END AS line FROM (SELECT DISTINCT set_id FROM whole)
    UNION ALL SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY sample_id) AS INT), sample_id || chr(9) || printf('%.1f', m1) || chr(9) || printf('%.1f', m2) || chr(9) || printf('%.1f', m3) FROM whole""", "whole",
)(lambda s, d: ex.export("genotypes", wide=gt.complete(wide(s, d), MARKERS3), markers=MARKERS3, labels=_dim(s)))
query(
    "export_arlequin_lines",
    f""", r AS (SELECT set_id, {NUMBER} AS i, row_number() OVER (ORDER BY set_id, sample_id) AS n, m1, m2, m3 FROM whole)
    SELECT set_id, n || ' 1 ' || """ + " || ' ' || ".join(f"printf('%02d%03d', i, CAST(m{m} AS INT))" for m in MARKERS3) + " AS line FROM r", "whole",
)(lambda s, d: ex.arlequin_rows(gt.complete(wide(s, d), MARKERS3), MARKERS3, SETS, recode=True).select("set_id", "line"))
query(
    "export_arlequin_document",
    f""", r AS (SELECT set_id, CAST({NUMBER} AS INT) AS part, sample_id || ' 1 ' || {_HAP} AS line FROM whole), sz AS (SELECT set_id, part, count(*) AS n FROM r GROUP BY ALL)
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY line) + 2 AS position, line FROM r
    UNION ALL SELECT part, 0, 'SampleName="' || set_id || '"' FROM sz UNION ALL SELECT part, 1, 'SampleSize=' || n FROM sz UNION ALL SELECT part, 2, 'SampleData= {{' FROM sz
    UNION ALL SELECT part, n + 3, '}}' FROM sz""", "whole",
)(lambda s, d: ex.export("arlequin", wide=gt.complete(wide(s, d), MARKERS3), markers=MARKERS3, sets=SETS).filter("part > 0"))
query(
    "export_alleles",
    "SELECT sample_id, marker_id, value, round(size, 6) AS size, round(height, 6) AS height FROM allele", "allele",
)(lambda s, d: rounded(_alleles_back(ex.export("alleles", alleles=tb.alleles(s, d)))))
query("plot_points", "SELECT vec_id AS channel_id, CAST(generate_subscripts(embedding, 1) - 1 AS DOUBLE) AS x, round(CAST(unnest(embedding) AS DOUBLE), 6) AS y FROM embeddings")(
    lambda s, d: rounded(_points_back(ex.plot_points(tb.traces(s, d))))
)


def _alleles_back(docs):
    """The rows that a reader of the documents gets."""
    kind = "map<string, array<struct<value:int,size:double,height:double>>>"
    per = docs.select("sample_id", F.explode(F.from_json("doc", kind)).alias("marker_id", "a"))
    return per.select("sample_id", F.col("marker_id").cast("bigint").alias("marker_id"), F.inline("a"))


def _points_back(points):
    rows = points.select("channel_id", F.explode(F.from_json("points", "array<array<double>>")).alias("p"))
    return rows.select("channel_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


# Stored tables.

query(
    "latest_rows",
    "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
)(lambda s, d: al.latest(tb.read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), "o_custkey", "o_orderkey"))
query(
    "snapshot", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
)(lambda s, d: _snapshot(s, d))


def _snapshot(s, d):
    orders = tb.read(s, d, "orders")
    return store.snapshot(orders.select("o_orderkey", "o_custkey"), orders.select(F.col("o_orderpriority").alias("uid"), "o_orderkey"), "1-URGENT", "o_orderkey")


query(
    "comprehensive",
    """, n AS (SELECT count(DISTINCT marker_id) AS m, count(DISTINCT set_id) AS s FROM facts)
    SELECT 'marker_summary' AS part, m AS n FROM n UNION ALL SELECT 'sample_summary', s FROM n UNION ALL SELECT 'clonality_by_he', m FROM n UNION ALL SELECT 'clonality_by_polyclonal', m FROM n
    UNION ALL SELECT 'allele_summary', count(*) FROM (SELECT DISTINCT set_id, marker_id, value FROM facts) UNION ALL SELECT 'marker_distribution', m FROM n
    UNION ALL SELECT 'rank_by_he', m FROM n UNION ALL SELECT 'rank_by_polyclonal', m FROM n UNION ALL SELECT 'loci_distribution', count(*) FROM (SELECT DISTINCT set_id, multi_loci FROM moi)
    UNION ALL SELECT 'sample_failures', s + 1 FROM n UNION ALL SELECT 'linkage', s FROM n
    UNION ALL SELECT 'fst', k * (k - 1) // 2 FROM (SELECT count(DISTINCT set_id) AS k FROM whole)""", "facts", "moi", "whole",
)(lambda s, d: _parts(sm.comprehensive(facts(s, d), MARKERS3)))


def _parts(tables):
    """The tables of the report with their numbers of rows."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [t.agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, t in tables.items()])


query("outside_domain", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0", "allele")(
    lambda s, d: store.outside_domain(tb.read(s, d, "orders").withColumn("peak_type", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise("peak-bin")), "peak_type").select("o_orderkey")
)
