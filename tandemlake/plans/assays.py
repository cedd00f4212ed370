"""Allele tables, assay lists and assay runs as queries over the stand-in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import LADDERS
from ..operators import assay as asy
from ..operators import imports as im
from ..operators import peaks as pk
from ..operators import signal as sg
from ..operators.spline import size_by_spline
from ..sources import tables as tb
from ..sources import tabular as tab
from ..storage import cut, shared_folder
from ..streaming import ingest, kept
from .queries import rounded
from .registry import query

LIZ = LADDERS["LIZ500"]

# A wide allele table made of the orders: an order is an assay of its customer, its first three lines are alleles.
WIDE = """w AS (SELECT 'S' || o_custkey AS sample, 'A' || o_orderkey AS assay, CASE o_orderkey % 3 WHEN 0 THEN 'M1' WHEN 1 THEN 'M2' ELSE 'M3' END AS marker,
  CASE o_orderkey % 2 WHEN 0 THEN 'B' ELSE 'NED' END AS dye, o_orderdate, o_custkey,
  max(CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS INT) END) AS v1, max(CASE WHEN l_linenumber = 2 THEN CAST(l_quantity AS INT) END) AS v2,
  max(CASE WHEN l_linenumber = 3 THEN CAST(l_quantity AS INT) END) AS v3, max(CASE WHEN l_linenumber = 1 THEN CAST(trunc(l_extendedprice) AS INT) END) AS h1,
  max(CASE WHEN l_linenumber = 2 THEN CAST(trunc(l_extendedprice) AS INT) END) AS h2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 3 GROUP BY ALL),
a AS (SELECT sample, assay, marker, 'P' AS panel, CASE dye WHEN 'B' THEN '6-FAM' ELSE dye END AS dye, CAST(0 AS INT) AS pos, v1 AS value, coalesce(h1, 300) AS height FROM w WHERE v1 IS NOT NULL
  UNION ALL SELECT sample, assay, marker, 'P', CASE dye WHEN 'B' THEN '6-FAM' ELSE dye END, 1, v2, coalesce(h2, 300) FROM w WHERE v1 IS NOT NULL AND v2 IS NOT NULL
  UNION ALL SELECT sample, assay, marker, 'P', CASE dye WHEN 'B' THEN '6-FAM' ELSE dye END, 2, v3, 300 FROM w WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL)
"""


def wide_table(s: SparkSession, d: str) -> DataFrame:
    """Text columns, as a reader of an allele table gives them."""
    items, orders = tb.read(s, d, "lineitem", "orders")
    per = items.filter("l_linenumber <= 3").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3])
    lines = per.agg(F.max(F.col("l_quantity").cast("int")).alias("q"), F.max(F.col("l_extendedprice").cast("int")).alias("h"))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    text = lambda c: F.col(c).cast("string")
    date = F.when(F.col("o_custkey") % 3 == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(F.col("o_custkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return rows.select(
        F.concat(F.lit("S"), text("o_custkey")).alias("SAMPLE"), F.concat(F.lit("A"), text("o_orderkey")).alias("ASSAY"),
        F.concat(F.lit("M"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("MARKER"), F.lit("P").alias("PANEL"),
        F.when(F.col("o_orderkey") % 2 == 0, "B").otherwise("NED").alias("DYE"), F.when(F.col("o_custkey") % 2 == 0, "MALAYSIA").alias("COUNTRY"),
        F.lit("Sabah").alias("ADMINL1"), date.alias("COLLECTION_DATE"), text("1_q").alias("ALLELE1"), text("2_q").alias("ALLELE2"), text("3_q").alias("ALLELE3"),
        text("1_h").alias("HEIGHT1"), text("2_h").alias("HEIGHT2"),
    )


query("table_alleles", f"WITH {WIDE} SELECT *, 0.0 AS size, CAST(0 AS INT) AS area FROM a")(lambda s, d: tab.alleles(wide_table(s, d)))
query(
    "table_samples",
    f"""WITH {WIDE}, s AS (SELECT sample AS code, CASE WHEN o_custkey % 2 = 0 THEN 'malaysia' ELSE '' END AS country, 'sabah' AS level1,
      CAST(min(CASE WHEN o_custkey % 3 = 2 THEN make_date(year(o_orderdate), 1, 1) ELSE CAST(o_orderdate AS DATE) END) AS VARCHAR) AS collection_date FROM w GROUP BY ALL) SELECT * FROM s""",
)(lambda s, d: tab.samples(wide_table(s, d)).select("code", F.col("collection_date").cast("string").alias("collection_date"), "country", "level1"))
query("table_documents", f"WITH {WIDE} SELECT *, 0.0 AS size, CAST(0 AS INT) AS area FROM a")(lambda s, d: tab.flatten_documents(tab.documents(wide_table(s, d))))
query("table_repeats", f"WITH {WIDE} SELECT sample AS SAMPLE, assay AS ASSAY, marker AS MARKER, count(*) * 2 AS n FROM w GROUP BY ALL")(
    lambda s, d: tab.repeated_markers(wide_table(s, d).unionAll(wide_table(s, d)))
)
query("relabelled", "SELECT CAST(n_nationkey AS BIGINT) AS id, 'R' || n_regionkey AS label FROM nation")(
    lambda s, d: tab.relabel(
        tb.read(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("label")),
        tb.read(s, d, "nation").select(F.col("n_name").alias("old"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("new")),
    )
)
query("short_labels", "SELECT n_name, CASE WHEN length('indonesia / ' || n_name || ' province / west') > 24 THEN 'IN / ' || upper(n_name[1]) || 'P / west' END AS label FROM nation")(
    lambda s, d: tb.read(s, d, "nation").select("n_name", scalar.short_location(F.concat(F.lit("indonesia / "), "n_name", F.lit(" province / west"))).alias("label"))
)
query("string_norms", "SELECT o_orderkey, array_to_string(list_sort(string_split(o_orderpriority, '-')), '/') AS species, upper(o_orderstatus[1]) = 'Y' AS yes FROM orders")(
    lambda s, d: tb.read(s, d, "orders").select("o_orderkey", scalar.species(F.replace("o_orderpriority", F.lit("-"), F.lit("/"))).alias("species"), scalar.truth(F.col("o_orderstatus")).alias("yes"))
)
query(
    "exclusions_unknown",
    """SELECT DISTINCT 'S' || c_custkey AS sample, 'f' || c_nationkey || '.fsa' AS fsa_file, 'm' || (c_nationkey % 5) AS marker FROM customer WHERE c_nationkey % 5 > 2""",
)(lambda s, d: _exclusions(s, d))


def _exclusions(s, d):
    rows = tb.read(s, d, "customer").select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("sample"), F.format_string("f%d.fsa", "c_nationkey").alias("fsa_file"), F.lit("P").alias("panel"),
        F.array(F.lit("m1"), F.format_string("m%d", F.col("c_nationkey") % 5)).alias("exclude"),
    )
    panels = s.range(1).select(F.inline(F.array(*[F.struct(F.lit("P").alias("panel"), F.lit(m).alias("marker")) for m in ("M0", "M1", "M2")])))
    return tab.unknown_exclusions(rows, panels)


# Assay runs: users are channels, five of a kind make the dyes.


def _channels(s, d):
    return tb.peaks(s, d).select("channel_id", "assay_id").distinct().withColumn("dye", F.element_at(F.array(*[F.lit(x) for x in ("liz", "6-FAM", "VIC", "NED", "PET")]), (F.col("channel_id") % 5 + 1).cast("int")))


def _panels(s):
    rows = [("P", "LIZ500", "M1", "6-fam"), ("P", "LIZ500", "M2", "VIC"), ("P", "LIZ500", "M3", "NED")]
    return s.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("panel", "ladder", "marker", "dye"), r)]) for r in rows])))


def _assays(s, d):
    return _channels(s, d).select("assay_id").distinct().select("assay_id", F.lit("P").alias("panel"), F.when(F.col("assay_id") % 4 == 0, F.array(F.lit("m2"))).alias("exclude"))


query(
    "assigned_channels",
    """, c AS (SELECT DISTINCT channel_id, assay_id, channel_id % 5 AS k FROM peak)
    SELECT channel_id, assay_id, CASE WHEN k = 1 THEN 'M1' WHEN k = 2 AND assay_id % 4 <> 0 THEN 'M2' WHEN k = 3 THEN 'M3' ELSE 'undefined' END AS marker,
      CASE WHEN k = 0 THEN 'channel-ladder' WHEN k = 4 OR k = 2 AND assay_id % 4 = 0 THEN 'channel-unassigned' ELSE 'channel-clean' END AS status, CASE WHEN k = 0 THEN 16 ELSE 0 END AS sizes FROM c""", "peak",
)(lambda s, d: asy.assign_channels(_channels(s, d), _assays(s, d), _panels(s), asy.ladder_table(s)).select("channel_id", "assay_id", "marker", "status", F.coalesce(F.size("sizes"), F.lit(0)).alias("sizes")))
query(
    "ladder_sizes",
    """WITH a AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'LIZ500' WHEN 1 THEN 'LIZ600' ELSE 'none' END AS ladder FROM orders), l AS (SELECT 'LIZ500' AS ladder, 'LIZ' AS dye, 16 AS n, 35.0 AS least, 500.0 AS most
      UNION ALL SELECT 'LIZ600', 'LIZ', 36, 20.0, 600.0) SELECT ladder, dye, n, least, most, count(*) AS assays FROM a LEFT JOIN l USING (ladder) GROUP BY ALL""",
)(lambda s, d: _with_ladder(s, d).groupBy("ladder", "dye", F.size("sizes").alias("n"), F.array_min("sizes").alias("least"), F.array_max("sizes").alias("most")).agg(F.count("*").alias("assays")))


def _with_ladder(s, d):
    """Assays by the ladder that their order's number names; one in three names an unknown one."""
    name = F.when(F.col("o_orderkey") % 3 == 0, "LIZ500").when(F.col("o_orderkey") % 3 == 1, "LIZ600").otherwise("none")
    assays = tb.read(s, d, "orders").select(name.alias("ladder"))
    return assays.join(F.broadcast(asy.ladder_table(s)), "ladder", "left")  # a row a ladder


query(
    "ladder_reports",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN 36 - user_id % 40 > 0 THEN 'QC missing peaks = ' || (36 - user_id % 40) END, CASE WHEN value > 1024 THEN 'QC RSS > 1024' END,
      CASE WHEN value > 255 THEN 'QC RSS > 255' END, CASE WHEN value > 50 THEN 'QC RSS > 50' END, CASE WHEN value <= 0 THEN 'QC RSS < 0' END], lambda x: x IS NOT NULL), '|') AS report FROM events""",
)(lambda s, d: tb.read(s, d, "events").select("event_id", scalar.ladder_reports(F.col("value"), F.col("user_id") % 40, F.lit(36)).alias("report")))


def _fits(s, d):
    """A line for a cubic; every third assay has a poor ladder."""
    z = F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0))
    score = F.when(F.col("assay_id") % 3 == 0, 0.4).when(F.col("assay_id") % 3 == 1, 0.7).otherwise(0.95)
    return _assays(s, d).select("assay_id", z.alias("z"), score.alias("score"), F.lit(5).alias("first_rtime"), F.lit(50).alias("last_rtime"))


def _scanned(s, d):
    rows = tb.peaks(s, d).drop("size").withColumns({"peak_type": F.lit("peak-scanned"), "rtime": F.col("rtime").cast("int")})
    return rows.withColumns({"brtime": F.col("rtime") - 1, "ertime": F.col("rtime") + 1 + (F.col("peak_id") % 3).cast("int"), "marker": F.concat(F.lit("M"), (F.col("channel_id") % 3 + 1).cast("string"))})


_CALLED = """, c AS (SELECT *, CASE WHEN rtime > 5 AND rtime < 50 THEN 2.0 * rtime + 1 ELSE -1 END AS s, rtime > 5 AND rtime < 50 AND 2 * rtime + 1 BETWEEN 20 AND 80 AS ok FROM peak),
k AS (SELECT *, CASE WHEN s - lag(s) OVER w < 2.25 AND lag(height) OVER w > height OR lead(s) OVER w - s < 2.25 AND lead(height) OVER w > height THEN 'peak-stutter' ELSE 'peak-called' END AS t
  FROM c WHERE ok AND assay_id % 3 <> 0 WINDOW w AS (PARTITION BY channel_id ORDER BY s, peak_id)),
called AS (SELECT peak_id, assay_id, channel_id, rtime, height, s AS size, t AS peak_type FROM k UNION ALL SELECT peak_id, assay_id, channel_id, rtime, height, s, 'peak-unassigned' FROM c WHERE NOT ok AND assay_id % 3 <> 0
  UNION ALL SELECT peak_id, assay_id, channel_id, rtime, height, NULL, 'peak-scanned' FROM c WHERE assay_id % 3 = 0)
"""
RUN = asy.RunParams(min_size=20, max_size=80, stutter=2.25)
query("called_peaks", _CALLED + "SELECT peak_id, round(size, 6) AS size, CAST(CASE WHEN size > 0 THEN round_even(size, 0) END AS INT) AS value, peak_type FROM called", "peak")(
    lambda s, d: rounded(asy.call_peaks(_scanned(s, d), _fits(s, d), RUN).select("peak_id", "size", "value", "peak_type"))
)
query(
    "checked_peaks",
    """, p AS (SELECT *, rtime - 1 AS b, rtime + 1 + peak_id % 3 AS e FROM peak WHERE assay_id % 3 = 2), v AS (SELECT vec_id, embedding FROM embeddings),
    st AS (SELECT peak_id FROM (SELECT *, size - lag(size) OVER w < 2.25 AND lag(height) OVER w > height OR lead(size) OVER w - size < 2.25 AND lead(height) OVER w > height AS y FROM p
      WINDOW w AS (PARTITION BY channel_id ORDER BY size, peak_id)) WHERE y),
    ov AS (SELECT DISTINCT x.peak_id FROM p x JOIN p y ON x.assay_id = y.assay_id AND x.channel_id <> y.channel_id AND x.b < y.e AND y.b < x.e AND x.height < y.height
      LEFT JOIN v vx ON vx.vec_id = x.channel_id LEFT JOIN v vy ON vy.vec_id = y.channel_id
      WHERE x.height < 1000 * abs(CAST(vy.embedding[x.rtime + 1] AS DOUBLE)) OR y.height < 1000 * abs(CAST(vx.embedding[y.rtime + 1] AS DOUBLE)))
    SELECT peak_id, CASE WHEN peak_id IN (SELECT peak_id FROM st) THEN 'peak-stutter' WHEN peak_id IN (SELECT peak_id FROM ov) THEN 'peak-overlap' ELSE 'peak-called' END AS peak_type FROM peak""", "peak",
)(lambda s, d: _checked(s, d))


def _checked(s, d):
    traces = tb.traces(s, d).withColumn("data", F.transform("data", lambda y: 1000 * F.abs(y)))
    channels = _channels(s, d).join(traces, "channel_id")
    peaks = _scanned(s, d).withColumns({"peak_type": F.lit("peak-called"), "size": F.col("rtime") * 0.75})
    return asy.check_peaks(peaks, channels, _fits(s, d), RUN).select("peak_id", "peak_type")


query(
    "binned_peaks",
    _CALLED + """SELECT peak_id, CASE WHEN size > 20 AND size < 80 AND channel_id % 3 < 2 THEN CAST(greatest(least(CASE WHEN size / 5 - floor(size / 5) > 0.5 THEN ceil(size / 5) ELSE floor(size / 5) END, 15), 5) * 5 AS INT)
      WHEN size > 0 THEN CAST(round_even(size, 0) AS INT) END AS value,
      CASE WHEN channel_id % 3 = 2 OR size IS NULL OR size < 0 THEN peak_type WHEN size > 20 AND size < 80 THEN 'peak-bin' ELSE 'peak-called' END AS peak_type FROM called""", "peak",
)(lambda s, d: _binned(s, d))


def _binned(s, d):
    bins = F.transform(F.sequence(F.lit(25), F.lit(75), F.lit(5)), lambda b: F.struct(b.cast("double").alias("pos"), b.alias("tag")))
    markers = s.range(1, 3).select(F.col("id").alias("marker_id"), F.concat(F.lit("M"), F.col("id").cast("string")).alias("code"), F.lit(3).alias("repeats"), F.lit(20.0).alias("min_size"), F.lit(80.0).alias("max_size"), bins.alias("bins"))
    return asy.bin_peaks(asy.call_peaks(_scanned(s, d), _fits(s, d), RUN), markers).select("peak_id", "value", "peak_type")


query(
    "set_types",
    "SELECT peak_id, CASE WHEN channel_id % 3 = 1 AND rtime IN (3, 7) AND peak_id % 2 = 0 THEN 'peak-noise' WHEN peak_id % 2 = 0 THEN 'peak-bin' ELSE 'peak-called' END AS peak_type FROM peak", "peak",
)(lambda s, d: asy.set_types(_scanned(s, d).withColumns({"value": F.col("rtime"), "peak_type": F.when(F.col("peak_id") % 2 == 0, "peak-bin").otherwise("peak-called")}), ["M2"], [3, 7], "peak-noise", "peak-bin").select("peak_id", "peak_type"))
query("accepted_peaks", "SELECT event_id AS peak_id, CASE WHEN value > 50 THEN 'peak-uncalled' ELSE 'peak-noise' END AS peak_type FROM events")(
    lambda s, d: asy.accept(tb.read(s, d, "events").select(F.col("event_id").alias("peak_id"), (F.col("value") - 50).alias("value"))).select("peak_id", "peak_type")
)
query("reset_assays", "SELECT peak_id FROM peak WHERE assay_id % 4 <> 0", "peak")(lambda s, d: asy.reset(_scanned(s, d), _assays(s, d).filter("assay_id % 4 = 0")).select("peak_id"))
query("repeated_files", "SELECT 'f' || c_nationkey AS fsa_file, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")(
    lambda s, d: asy.repeated_files(tb.read(s, d, "customer").select(F.format_string("f%d", "c_nationkey").alias("fsa_file")))
)
query("assays_by_keys", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '5-LOW')")(
    lambda s, d: asy.by_keys(tb.read(s, d, "orders").withColumnsRenamed({"o_orderstatus": "batch", "o_orderpriority": "panel"}), batch="O", panel=["1-URGENT", "5-LOW"], sample=None).select("o_orderkey")
)
query("series_bins", "SELECT CAST(p_size AS INT) AS value, CAST(unnest(range((200 // 3 + 1) * 3 + p_size % 3, 400, 3)) AS INT) AS tag FROM (SELECT DISTINCT p_size FROM part)")(
    lambda s, d: tb.read(s, d, "part").select(F.col("p_size").cast("int").alias("value")).distinct().select("value", F.explode(asy.series_bins(F.col("value"))).alias("b")).select("value", "b.tag")
)
query("overlap_with_signal", """, e AS (SELECT *, rtime - 1 AS b, rtime + 1 + peak_id % 3 AS e FROM peak)
    SELECT DISTINCT x.peak_id FROM e x JOIN e y ON x.assay_id = y.assay_id AND x.channel_id <> y.channel_id AND x.b < y.e AND y.b < x.e AND x.height < y.height
      LEFT JOIN embeddings vx ON vx.vec_id = x.channel_id LEFT JOIN embeddings vy ON vy.vec_id = y.channel_id
      WHERE x.height < 1000 * abs(CAST(vy.embedding[x.rtime + 1] AS DOUBLE)) OR y.height < 1000 * abs(CAST(vx.embedding[y.rtime + 1] AS DOUBLE))""", "peak")(
    lambda s, d: pk.overlaps(_scanned(s, d), _channels(s, d).join(tb.traces(s, d).withColumn("data", F.transform("data", lambda y: 1000 * F.abs(y))), "channel_id"))
)
query("arrivals", "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS end, count(*) AS n FROM events GROUP BY ALL")(
    lambda s, d: ingest.arrivals(tb.read(s, d, "events"), "ts", "1 day", "1 hour")
)


def _window_sql(name: str, window: int) -> str:
    import numpy as np

    w = {"hamming": np.hamming, "flat": np.ones}[name](window)
    return f"""WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS d FROM embeddings),
    w AS (SELECT vec_id, list_concat(list_concat(list_reverse(d[2:{window}]), d), list_reverse(d[len(d) - {window - 2}:len(d)])) AS wide FROM c)
    SELECT vec_id AS channel_id, CAST(t AS INT) AS t, round(list_inner_product(wide[t + 1:t + {window}], {(w / w.sum()).tolist()}), 6) AS y FROM w, range(0, {64 + window - 1}) r(t)"""


for _name in ("hamming", "flat"):
    query(f"window_{_name}", _window_sql(_name, 7))(lambda s, d, n=_name: rounded(sg.points(sg.window_smooth(tb.traces(s, d), 7, n))))
query(
    "qc_listing",
    """, x AS (SELECT DISTINCT assay_id FROM peak) SELECT 'S' || assay_id AS sample, 'f' || assay_id AS fsa_file, CASE WHEN assay_id % 3 <> 0 THEN assay_id / 2.0 END AS rss,
    CASE WHEN assay_id % 3 <> 0 THEN 0.9 END AS score, CASE WHEN assay_id % 3 <> 0 THEN 'ok' END AS report FROM x""", "peak",
)(lambda s, d: _listing(s, d))


def _listing(s, d):
    assays = _assays(s, d).select("assay_id", F.format_string("S%d", "assay_id").alias("sample"), F.format_string("f%d", "assay_id").alias("fsa_file"))
    ladders = assays.filter("assay_id % 3 <> 0").select("assay_id", (F.col("assay_id") / 2.0).alias("rss"), F.lit(0.9).alias("score"), F.lit("ok").alias("report"))
    return asy.qc_listing(assays, ladders)


query(
    "imported",
    f"WITH {WIDE}, m AS (SELECT DISTINCT marker FROM a), s AS (SELECT sample, marker, count(*) AS n FROM a GROUP BY ALL) SELECT sample, marker, n, CASE WHEN CAST(substr(sample, 2) AS BIGINT) % 2 = 0 THEN 3 ELSE 2 END AS revision FROM s",
)(lambda s, d: _imported(s, d))


def _imported(s, d):
    """All samples of the wide table by three imports: the even ones as a new batch, the others, and the even ones' alleles
    once more."""
    docs = cut(tab.documents(wide_table(s, d)))
    even = F.substring("code", 2, 20).cast("bigint") % 2 == 0
    stored = im.empty(s, s.range(1, 4).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("code")))
    for mode, part in (("new", docs.filter(even)), ("sample", docs.filter(~even)), ("allele", docs.filter(even))):
        stored, errors = im.import_documents(part, "B", stored, mode)
        if not errors.isEmpty():
            raise ValueError(f"errors of an import: {errors.first()}")
    return im.latest_alleles(stored).groupBy("sample", "marker", "revision").agg(F.count("*").alias("n")).select("sample", "marker", "n", "revision")


# Fits.

query(
    "peak_fits",
    """WITH t AS (SELECT vec_id AS channel_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS y FROM embeddings), p AS (SELECT channel_id, y, list_position(y, list_max(y)) - 1 AS rtime FROM t),
    w AS (SELECT channel_id, rtime, unnest(range(-3, 4)) AS u, y FROM p), q AS (SELECT channel_id, rtime, u::DOUBLE AS u, ln(y[rtime + u + 1]) AS z FROM w WHERE rtime + u BETWEEN 0 AND len(y) - 1 AND y[rtime + u + 1] > 0),
    m AS (SELECT channel_id, rtime, count(*) AS n, count(*)::DOUBLE AS s0, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(z) AS t0, sum(u * z) AS t1, sum(u * u * z) AS t2 FROM q GROUP BY ALL),
    e AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS w FROM m),
    f AS (SELECT channel_id, rtime, n, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / w AS c, (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / w AS b,
      (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / w AS a FROM e)
    SELECT channel_id, CAST(rtime AS INT) AS rtime, n, CASE WHEN n >= 3 AND a < -1e-9 THEN round(rtime - b / (2 * a), 4) END AS centre, CASE WHEN n >= 3 AND a < -1e-9 THEN round(sqrt(-1 / (2 * a)), 4) END AS sigma,
      CASE WHEN n >= 3 AND a < -1e-9 THEN round(exp(c - b * b / (4 * a)), 6) END AS top FROM f""",
)(lambda s, d: _fitted(s, d))


def _fitted(s, d):
    """The highest place of each trace."""
    traces = tb.traces(s, d).withColumn("data", F.transform("data", F.abs))
    peaks = traces.select("channel_id", (F.array_position("data", F.array_max("data")) - 1).cast("int").alias("rtime"))
    return sg.peak_fits(traces, peaks).select("channel_id", "rtime", "n", F.round("centre", 4).alias("centre"), F.round("sigma", 4).alias("sigma"), F.round("top", 6).alias("top"))


@query("spline_sizes")
def spline_sizes(s, d):
    """Peaks of all assays by the splines of ladders whose times are shifted by the assay's own heights."""
    peaks = tb.peaks(s, d)
    slots = peaks.groupBy("assay_id", (F.col("peak_id") % len(LIZ)).cast("int").alias("k")).agg(F.avg("height").alias("h"))
    sizes = F.array(*[F.lit(float(x)) for x in LIZ])
    point = F.struct((F.get(sizes, F.col("k")) / 10 + F.pmod(F.col("h"), F.lit(0.8))).alias("rtime"), F.get(sizes, F.col("k")).alias("size"))
    ladders = slots.groupBy("assay_id").agg(F.array_sort(F.collect_list(point)).alias("x")).select("assay_id", F.col("x.rtime").alias("rtimes"), F.col("x.size").alias("sizes"))
    return rounded(size_by_spline(peaks, ladders).select("peak_id", "size"), 4)


def kept_batches(s, d):
    """The alleles of the table arrive in four batches, two of which are merged in between."""
    folder = f"{shared_folder(s).rstrip('/')}/kept-{uuid.uuid4().hex}"
    rows = tb.alleles(s, d)
    for batch in range(4):
        kept.add_batch(rows.filter(F.col("sample_id") % 4 == batch), folder, batch)
        if batch == 1:
            kept.compact(s, folder)
    return kept.kept_counts(s, folder)


query("kept_moi", "SELECT sample_id, max(n) AS moi, count(*) FILTER (n > 1) AS multi_loci FROM (SELECT sample_id, marker_id, count(*) AS n FROM allele GROUP BY ALL) GROUP BY ALL", "allele")(
    lambda s, d: kept.kept_moi(kept_batches(s, d))
)
query("kept_alleles", "SELECT marker_id, value::DOUBLE AS value, n, round(n / sum(n) OVER (PARTITION BY marker_id), 6) AS freq FROM (SELECT marker_id, value, count(*) AS n FROM allele GROUP BY ALL)", "allele")(
    lambda s, d: rounded(kept.kept_alleles(kept_batches(s, d)).withColumn("n", F.col("n").cast("bigint")))
)


# A whole run.


def run_traces(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """(channels, assays, panels, markers) of runs made of the tables: each supplier is an assay of a ladder channel and
    of two others. A channel's trace is a sum of peaks, of the ladder's sizes or at places and heights that follow from
    the supplier's balance; every fifth assay's ladder is too weak."""
    vectors = tb.read(s, d, "supplier").select(F.col("s_suppkey").alias("assay_id"), F.col("s_acctbal").cast("double").alias("balance"))
    place = lambda size: 400 + size * 8.0
    value = lambda i: F.pmod(F.col("balance") * (i + 1) * 0.0137, F.lit(1.0))
    weak = F.when(F.col("assay_id") % 5 == 4, 0.0).otherwise(1.0)
    ladder = [(F.lit(place(x)), 600.0 * weak) for x in LIZ]
    one = [(F.round(place(205 + F.pmod(value(3 * k) * 997, F.lit(100.0)))), 300 + F.pmod(value(3 * k + 1) * 9973, F.lit(900.0))) for k in range(3)]
    two = [(F.round(place(205 + F.pmod(value(20 + 3 * k) * 997, F.lit(100.0)))), 300 + F.pmod(value(21 + 3 * k) * 9973, F.lit(900.0))) for k in range(2)]

    def trace(bells: Column) -> Column:
        """Places 0 to 4799: a ripple, and near each peak its bell. Stretches of 48 places look at the bells near them."""
        bell = lambda x, near: F.aggregate(near, F.lit(0.0), lambda acc, b: acc + F.when(F.abs(x - b["p"]) < 12, b["h"] * F.exp(-F.pow((x - b["p"]) / 2.5, F.lit(2.0)) / 2)).otherwise(0.0))
        parts = F.transform(F.sequence(F.lit(0), F.lit(4_752), F.lit(48)), lambda k: F.struct(k.alias("k"), F.filter(bells, lambda b: (b["p"] > k - 12) & (b["p"] < k + 60)).alias("near")))
        return F.flatten(F.transform(parts, lambda e: F.transform(F.sequence(e["k"], e["k"] + 47), lambda x: 0.3 * F.sin(x * 0.9) + bell(x.cast("double"), e["near"]))))

    bells = lambda peaks: F.array(*[F.struct(p.alias("p"), h.alias("h")) for p, h in peaks])
    kinds = [("LIZ", 0, ladder), ("6-FAM", 1, one), ("VIC", 2, two)]
    channels = F.array(*[F.struct(F.lit(dye).alias("dye"), (F.col("assay_id") * 3 + i).alias("channel_id"), bells(peaks).alias("bells")) for dye, i, peaks in kinds])
    # A supplier is a short row of much work: left to their sizes, all would be one task. Suppliers are dealt out, not their
    # traces, which are made where they are read.
    n = vectors.count()
    tasks = max(1, min(n, max(4 * s.sparkContext.defaultParallelism, n // 100)))
    rows = vectors.repartition(tasks, "assay_id").select("assay_id", F.inline(channels)).select("assay_id", "dye", "channel_id", trace(F.col("bells")).alias("data"))
    assays = vectors.select("assay_id", F.lit("P").alias("panel"), F.when(F.col("assay_id") % 7 == 3, F.array(F.lit("m2"))).alias("exclude"))
    panels = s.range(1).select(F.inline(F.array(*[F.struct(F.lit("P").alias("panel"), F.lit("LIZ500").alias("ladder"), F.lit(m).alias("marker"), F.lit(c).alias("dye")) for m, c in (("M1", "6-FAM"), ("M2", "VIC"))])))
    bins = F.transform(F.sequence(F.lit(200), F.lit(320), F.lit(3)), lambda b: F.struct(b.cast("double").alias("pos"), b.alias("tag")))
    markers = s.range(1, 3).select(F.col("id").alias("marker_id"), F.concat(F.lit("M"), F.col("id").cast("string")).alias("code"), F.lit(3).alias("repeats"), F.lit(190.0).alias("min_size"), F.lit(330.0).alias("max_size"), bins.alias("bins"))
    return rows, assays, panels, markers


@query("assay_run")
def assay_run(s, d):
    """All assays from traces to bins: peak, channel, type, size, value and bin of each peak."""
    channels, assays, panels, markers = run_traces(s, d)
    out = asy.process(channels, assays, panels, asy.ladder_table(s), markers)
    return rounded(out["peaks"].select("assay_id", "channel_id", "marker", "rtime", "size", "value", "peak_type"), 3)
