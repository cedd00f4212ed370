"""Allele tables, assay lists, sample documents and marker definitions as DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DYES

# The columns of an allele table, and the prefixes of its numbered ones.
HEADERS = (
    "SAMPLE", "PANEL", "ASSAY", "MARKER", "DYE", "NEST", "STANDARD", "COUNTRY", "ADMINL1", "ADMINL2", "ADMINL3", "ADMINL4",
    "COLLECTION_DATE", "COMMENTS", "FSA_COMMENTS",
)
PREFIXES = ("ALLELE", "SIZE", "HEIGHT", "AREA")
DEFAULT_HEIGHT = 300
SEPARATORS = {"csv": ",", "tab": "\t", "tsv": "\t", "txt": "\t"}


def check_headers(columns: list[str]) -> None:
    unknown = [c for c in columns if c not in HEADERS and not c.startswith(PREFIXES)]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")


def _numbered(columns: list[str], prefix: str) -> list[str]:
    return [c for c in columns if c.startswith(prefix)]


def read_alleles(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """The wide table as it is, all columns text; the separator comes from the extension unless given."""
    sep = sep or SEPARATORS.get(path.rsplit(".", 1)[-1].lower(), ",")
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    check_headers(df.columns)
    return df


def collection_date(text: Column) -> Column:
    """Month first; what is missing comes from 1990-01-01, as does a date that can't be read."""
    text = F.trim(text)
    full = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "yyyy-M-d")])
    month = F.coalesce(*[F.try_to_timestamp(F.concat(text, F.lit(s)), F.lit(p)) for s, p in (("/1", "M/yyyy/d"), ("-1", "yyyy-M-d"))])
    year = F.try_to_timestamp(F.concat(text, F.lit("-1-1")), F.lit("yyyy-M-d"))
    return F.coalesce(full, month, year, F.to_timestamp(F.lit("1990-01-01"))).cast("date")


def sample_columns(columns: list[str]) -> list[Column]:
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in columns else F.lit("")
    return [
        F.col("SAMPLE").alias("code"), collection_date(text("COLLECTION_DATE")).alias("collection_date"),
        *[F.lower(text(c)).alias(a) for c, a in zip(("COUNTRY", "ADMINL1", "ADMINL2", "ADMINL3", "ADMINL4"), ("country", "level1", "level2", "level3", "level4"))],
        (F.col("COMMENTS") if "COMMENTS" in columns else F.lit(None).cast("string")).alias("comments"),
    ]


def samples(wide: DataFrame) -> DataFrame:
    """A row per sample: of its lines the first by all columns."""
    return wide.select(*sample_columns(wide.columns)).groupBy("code").agg(F.min(F.struct("collection_date", "country", "level1", "level2", "level3", "level4", "comments")).alias("s")).select("code", "s.*")


def dye(code: Column) -> Column:
    """One-letter codes to dyes; other names stay."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DYES.items() for x in kv]), F.upper(code)), code)


def alleles(wide: DataFrame) -> DataFrame:
    """sample, assay, marker, panel, dye, pos, value, size, height, area: the numbered columns zipped by position.

    A line's alleles end at the first that is empty or 0; height is 300 unless given, size and area 0. Lines without
    an assay describe a sample only.
    """
    columns = wide.columns
    groups = {p: _numbered(columns, p) for p in PREFIXES}
    number = lambda c, kind, default: F.coalesce(F.expr(f"try_cast(`{c}` AS {kind})"), F.lit(default))
    items = []
    for i, name in enumerate(groups["ALLELE"]):
        pick = lambda p, kind, default: number(groups[p][i], kind, default) if i < len(groups[p]) else F.lit(default)  # noqa: B023, E731
        items.append(
            F.struct(
                number(name, "int", 0).alias("value"), pick("SIZE", "double", 0.0).cast("double").alias("size"),
                pick("HEIGHT", "int", DEFAULT_HEIGHT).alias("height"), pick("AREA", "int", 0).alias("area"),
            )
        )
    if not items:
        raise ValueError("no ALLELE column")
    every = F.array(*items)
    end = F.array_position(F.transform(every, lambda a: a["value"] == 0), True)
    taken = F.when(end > 0, F.slice(every, 1, (end - 1).cast("int"))).otherwise(every)
    has = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    rows = wide.filter(F.coalesce(has("ASSAY"), F.lit("")) != "").select(
        F.col("SAMPLE").alias("sample"), F.col("ASSAY").alias("assay"), F.col("MARKER").alias("marker"),
        has("PANEL").alias("panel"), dye(has("DYE")).alias("dye"), F.posexplode(taken).alias("pos", "a"),
    )
    return rows.select("sample", "assay", "marker", "panel", "dye", "pos", "a.*")


def repeated_markers(wide: DataFrame) -> DataFrame:
    """Markers that an assay has on more than one line: an error of the table."""
    return wide.filter("ASSAY IS NOT NULL").groupBy("SAMPLE", "ASSAY", "MARKER").agg(F.count("*").alias("n")).filter("n > 1")


def documents(wide: DataFrame) -> DataFrame:
    """code, doc: the nested JSON document of each sample."""
    per = alleles(wide).groupBy("sample", "assay", "marker", "panel", "dye").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "size", "height", "area"))).alias("a"))
    values = F.transform("a", lambda x: F.struct(x["value"].alias("value"), x["size"].alias("size"), x["height"].alias("height"), x["area"].alias("area")))
    assay = per.groupBy("sample", "assay", "panel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("marker", F.struct("dye", values.alias("alleles")))))).alias("markers"))
    nested = assay.groupBy("sample").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("assay", F.struct("panel", "markers"))), lambda a, b: F.when(a["assay"] < b["assay"], -1).when(a["assay"] > b["assay"], 1).otherwise(0))).alias("assays"))
    joined = samples(wide).join(nested, F.col("code") == F.col("sample"), "left")
    place = F.array("country", "level1", "level2", "level3", "level4")
    return joined.select("code", F.to_json(F.struct(F.date_format("collection_date", "yyyy/MM/dd").alias("collection_date"), place.alias("location"), "comments", "assays")).alias("doc"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """code, doc of the samples of JSON files that hold {code: document}, or {batch: {"samples": {code: document}}}.

    YAML files (.yaml, .yml) are configuration-sized: the driver reads them.
    """
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        files = spark.createDataFrame([(json.dumps(yaml.safe_load(text) or {}, default=str),)], "value string")
    else:
        files = spark.read.text(path, wholetext=True)
    each = lambda column, name: F.explode(F.from_json(column, "map<string,string>")).alias(name, "doc")
    top = files.select(each("value", "code"))
    inner = F.get_json_object("doc", "$.samples")
    return top.filter(inner.isNull()).unionByName(top.filter(inner.isNotNull()).select(inner.alias("inner")).select(each("inner", "code")))


def import_errors(docs: DataFrame, batch: str, batches: DataFrame, samples: DataFrame, markers: DataFrame, mode: str = "new", alleles: DataFrame | None = None) -> DataFrame:
    """code, error: what forbids an import of documents (code, doc) into a batch; empty if nothing does.

    Modes: `new` needs a new batch. The others need a stored one: `sample` adds samples that it lacks, `allele` and `info`
    change samples that it has. batches: code. samples: batch, code. markers: code, in any case. alleles: those of the documents, if read before.
    """
    if mode not in ("new", "sample", "allele", "info"):
        raise ValueError(f"unknown mode {mode}")
    stored = batches.filter(F.lower("code") == batch.lower()).agg(F.count("*").alias("n"))
    wrong = stored.filter("n > 0").select(F.lit("batch exists").alias("error")) if mode == "new" else stored.filter("n = 0").select(F.lit("no such batch").alias("error"))
    out = wrong.select(F.lit(None).cast("string").alias("code"), "error")
    own = samples.filter(F.lower("batch") == batch.lower()).select("code")
    if mode == "sample":
        out = out.unionByName(docs.join(own, "code", "left_semi").select("code", F.lit("sample exists").alias("error")))
    elif mode != "new":
        out = out.unionByName(docs.join(own, "code", "left_anti").select("code", F.lit("no such sample").alias("error")))
    if mode != "info":
        used = (flatten_documents(docs) if alleles is None else alleles).select(F.col("sample").alias("code"), F.lower("marker").alias("marker")).distinct()
        unknown = used.join(markers.select(F.lower("code").alias("marker")), "marker", "left_anti")
        out = out.unionByName(unknown.select("code", F.concat(F.lit("no such marker: "), "marker").alias("error")))
    return out


def stored_alleles(docs: DataFrame) -> DataFrame:
    """The alleles of documents as they are stored: binned elsewhere."""
    return flatten_documents(docs).withColumns({"peak_type": F.lit("peak-bin"), "method": F.lit("binning-external")})


def flatten_documents(docs: DataFrame) -> DataFrame:
    """The alleles of nested documents (code, doc), written as objects or as lists of value, size, height and area."""
    kind = "assays map<string, struct<panel:string,markers:map<string,struct<dye:string,alleles:array<string>>>>>"
    item = lambda a, name, i: F.coalesce(F.get_json_object(a, f"$.{name}"), F.get_json_object(a, f"$[{i}]"))
    kinds = (("value", "int"), ("size", "double"), ("height", "int"), ("area", "int"))
    read = lambda a: F.struct(*[item(a, n, i).cast("double").cast(k).alias(n) for i, (n, k) in enumerate(kinds)])
    rows = docs.select("code", F.explode(F.from_json("doc", kind)["assays"]).alias("assay", "x"))
    rows = rows.select("code", "assay", F.col("x.panel").alias("panel"), F.explode("x.markers").alias("marker", "m"))
    rows = rows.select("code", "assay", "panel", "marker", F.col("m.dye").alias("dye"), F.posexplode(F.transform("m.alleles", read)).alias("pos", "a"))
    return rows.select(F.col("code").alias("sample"), "assay", "marker", "panel", "dye", "pos", "a.*")


def assay_list(spark: SparkSession, path: str) -> DataFrame:
    """sample, fsa_file, panel, exclude: a row for each panel of a line; options are `exclude=m1,m2;...`."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#").toDF("sample", "fsa_file", "panels", "options")
    exclude = F.regexp_extract(F.coalesce("options", F.lit("")), r"exclude=([^;]*)", 1)
    names = F.filter(F.transform(F.split(exclude, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return rows.select("sample", "fsa_file", F.explode(F.split("panels", r"\s*,\s*")).alias("panel"), names.alias("exclude"))


def unknown_exclusions(assays: DataFrame, panels: DataFrame) -> DataFrame:
    """Excluded markers that none of the line's panels (panel, marker) has."""
    wanted = assays.select("sample", "fsa_file", F.explode("exclude").alias("marker")).distinct()
    known = assays.join(panels, "panel").select("sample", "fsa_file", F.lower("marker").alias("marker"))
    return wanted.join(known, ["sample", "fsa_file", "marker"], "left_anti")


def definitions(spark: SparkSession, text: str, kind: str, names: list[str] | None = None) -> DataFrame:
    """Markers or panels of a YAML or JSON definition file (a configuration, read by the driver); those of `names`, in any
    case, if given. A key that isn't its item's code is an error."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    items = data.values() if isinstance(data, dict) and "code" not in data else data if isinstance(data, list) else [data]
    if isinstance(data, dict) and "code" not in data and (wrong := [k for k, v in data.items() if k != v["code"]]):
        raise ValueError(f"keys that are not the codes of their items: {wrong}")
    if names is not None:
        items = [x for x in items if x["code"].lower() in {n.lower() for n in names}]
    if kind == "marker":
        rows = [(m["code"], m.get("locus"), int(m.get("repeats") or 0), float(m.get("min_size") or 0), float(m.get("max_size") or 0), [(float(p), int(t)) for p, t in m.get("bins") or []]) for m in items]
        return spark.createDataFrame(rows, "code string, locus string, repeats int, min_size double, max_size double, bins array<struct<pos:double,tag:int>>")
    rows = [(p["code"], p["data"].get("ladder"), {k: v.get("dye") for k, v in p["data"]["markers"].items()}) for p in items]
    return spark.createDataFrame(rows, "code string, ladder string, markers map<string,string>")


def panel_markers(panels: DataFrame) -> DataFrame:
    """panel, ladder, marker, dye: a row for each marker of a panel."""
    return panels.select(F.col("code").alias("panel"), "ladder", F.explode("markers").alias("marker", "dye"))


def relabel(rows: DataFrame, names: DataFrame, column: str = "label") -> DataFrame:
    """Labels replaced by a table (old, new); a label that it lacks is an error when the rows are computed."""
    joined = rows.join(names, rows[column] == names["old"], "left")
    checked = F.when(F.col("new").isNull(), F.raise_error(F.concat(F.lit("no new label for "), F.col(column)))).otherwise(F.col("new"))
    return joined.withColumn(column, checked.cast("string")).select(*rows.columns)


def number_suffix(name: str) -> int:
    """The number at the end of a column's name, 0 without."""
    return int((re.search(r"\d+$", name) or ["0"])[0])


def unknown_panel_markers(panels: DataFrame, markers: DataFrame) -> DataFrame:
    """panel, marker of panels' markers that no definition has: an error of the panels."""
    return panel_markers(panels).select("panel", "marker").join(markers.select(F.lower("code").alias("known")), F.lower("marker") == F.col("known"), "left_anti")
