"""Text exports for genetics tools, as tables of lines; write them with `df.write.text`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered

MISSING = "-9"


def _values(markers: list[int]) -> list[Column]:
    return [F.coalesce(F.col(f"m{m}").cast("int").cast("string"), F.lit(MISSING)) for m in markers]


def _set_index(sets: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col("set_id") == s, F.lit(i)) for i, s in enumerate(sets, 1)], F.lit(0))


def flat(wide: DataFrame, markers: list[int]) -> DataFrame:
    """line: sample id and values."""
    return wide.select(F.concat_ws(" ", F.col("sample_id").cast("string"), *_values(markers)).alias("line"))


def structure(wide: DataFrame, markers: list[int], sets: list[str]) -> DataFrame:
    """line: sample id, number of the set, values, -9 where missing."""
    return wide.select(F.concat_ws(" ", F.col("sample_id").cast("string"), _set_index(sets).cast("string"), *_values(markers)).alias("line"))


def structure_params(markers: list[int], samples: int, sets: int) -> str:
    """The main settings that go with the data."""
    lines = {"NUMINDS": samples, "NUMLOCI": len(markers), "PLOIDY": 1, "MISSING": MISSING, "MAXPOPS": sets, "ONEROWPERIND": 1, "LABEL": 1, "POPDATA": 1, "MARKERNAMES": 0}
    return "".join(f"#define {k} {v}\n" for k, v in lines.items())


def arlequin_rows(wide: DataFrame, markers: list[int], sets: list[str], recode: bool = False) -> DataFrame:
    """set_id, head, line of each sample. Recoded: a running number instead of the id, and values marked by their set."""
    if recode:
        rows = numbered(wide, ["set_id", "sample_id"])
        values = [F.format_string("%02d%03d", _set_index(sets), F.col(f"m{m}").cast("int")) for m in markers]
        head = F.concat_ws(" ", F.col("number").cast("string"), F.lit("1"), _set_index(sets).cast("string"))
        return rows.select("set_id", head.alias("head"), F.concat_ws(" ", F.col("number").cast("string"), F.lit("1"), *values).alias("line"))
    ident = F.col("sample_id").cast("string")
    return wide.select("set_id", F.concat_ws(" ", ident, F.lit("1"), _set_index(sets).cast("string")).alias("head"), F.concat_ws(" ", ident, F.lit("1"), *_values(markers)).alias("line"))


def arlequin_header(sets: int) -> str:
    return f'[Profile]\nTitle="samples"\nNbSamples={sets}\nDataType=STANDARD\nGenotypicData=0\nLocusSeparator=WHITESPACE\nMissingData="?"\n[Data]\n[[Samples]]\n'


def arlequin_document(wide: DataFrame, markers: list[int], sets: list[str], recode: bool = False) -> DataFrame:
    """part, position, line: the whole project in order: the head, then each set's block. Order by both and write."""
    rows = arlequin_rows(wide, markers, sets, recode)
    index = _set_index(sets)
    order = Window.partitionBy("set_id").orderBy("line")
    body = rows.select(index.alias("part"), (F.row_number().over(order) + 2).cast("bigint").alias("position"), "line")
    sizes = rows.groupBy("set_id").agg(F.count("*").alias("n"))
    opening = F.array(F.format_string('SampleName="%s"', "set_id"), F.format_string("SampleSize=%d", "n"), F.lit("SampleData= {"))
    heads = sizes.select(index.alias("part"), F.posexplode(opening).alias("position", "line")).withColumn("position", F.col("position").cast("bigint"))
    ends = sizes.select(index.alias("part"), (F.col("n") + 3).alias("position"), F.lit("}").alias("line"))
    top = wide.sparkSession.range(1).select(F.lit(0).alias("part"), F.posexplode(F.split(F.lit(arlequin_header(len(sets)).rstrip("\n")), "\n")).alias("position", "line"))
    return top.withColumn("position", F.col("position").cast("bigint")).unionByName(heads).unionByName(body).unionByName(ends)


def genotype_lines(wide: DataFrame, markers: list[int], labels: DataFrame) -> DataFrame:
    """set_id, position, line: for each set its label's line, then its genotypes with tabs, by sample; missing values empty."""
    value = [F.coalesce(F.format_string("%.1f", F.col(f"m{m}").cast("double")), F.lit("")) for m in markers]
    order = Window.partitionBy("set_id").orderBy("sample_id")
    rows = wide.select("set_id", F.row_number().over(order).alias("position"), F.concat_ws("\t", F.col("sample_id").cast("string"), *value).alias("line"))
    heads = labels.select("set_id", F.lit(0).alias("position"), F.format_string("Label: %s", "label").alias("line"))
    return heads.unionByName(rows)


def export(kind: str, **tables) -> DataFrame:
    """The export of a kind: flat, structure, arlequin, genotypes or alleles, from the arguments that it takes."""
    kinds = {"flat": flat, "structure": structure, "arlequin": arlequin_document, "genotypes": genotype_lines, "alleles": allele_document}
    if kind not in kinds:
        raise ValueError(f"unknown export {kind}: one of {sorted(kinds)}")
    return kinds[kind](**tables)


def marker_document(markers: DataFrame) -> DataFrame:
    """code, doc: JSON of each marker's definition, as `tabular.definitions` reads it."""
    bins = F.transform("bins", lambda b: F.array(b["pos"], b["tag"].cast("double")))
    return markers.select("code", F.to_json(F.struct("code", "locus", "repeats", "min_size", "max_size", bins.alias("bins"))).alias("doc"))


def panel_document(panels: DataFrame) -> DataFrame:
    """code, doc: JSON of each panel's definition."""
    own = F.map_from_entries(F.transform(F.map_entries("markers"), lambda e: F.struct(e["key"], F.struct(e["value"].alias("dye")))))
    return panels.select("code", F.to_json(F.struct("code", F.struct("ladder", own.alias("markers")).alias("data"))).alias("doc"))


def allele_document(alleles: DataFrame) -> DataFrame:
    """sample_id, doc: JSON of marker -> [(value, size, height)], the highest first."""
    per = alleles.groupBy("sample_id", "marker_id").agg(F.sort_array(F.collect_list(F.struct("height", "value", "size")), False).alias("a"))
    per = per.withColumn("a", F.transform("a", lambda x: F.struct(x["value"].alias("value"), x["size"].alias("size"), x["height"].alias("height"))))
    doc = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("marker_id").cast("string"), F.col("a"))))))
    return per.groupBy("sample_id").agg(doc.alias("doc"))


def plot_points(traces: DataFrame) -> DataFrame:
    """channel_id, points: JSON of [[x, y], ...]."""
    pairs = F.transform("data", lambda y, i: F.array(i.cast("double"), y))
    return traces.select("channel_id", F.to_json(pairs).alias("points"))
