"""Sample sets: predicates, set algebra and differentiation. A set is a table of sample ids; many sets are one table
with a set_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalar import LEVELS, location, quarter, short_location
from ..model import COLOURS


def allele_range(text: str) -> Column:
    """'200-230' (both ends), '>=200', '<=200', '>200', '<200' or '200', on the value column."""
    value = F.col("value")
    if "-" in text:
        low, high = text.split("-", 1)
        return value.between(float(low), float(high))
    for sign, compare in ((">=", value.__ge__), ("<=", value.__le__), (">", value.__gt__), ("<", value.__lt__)):
        if text.startswith(sign):
            return compare(float(text[len(sign) :]))
    return value == float(text)


def _predicates(fields: dict) -> tuple[Column, Column | None]:
    """What the fields ask of a sample, and of one of its alleles (None: nothing)."""
    wanted = ~F.col("recurrent")
    for name, x in fields.items():
        if name in LEVELS:
            wanted = wanted & (F.col(name) == x)
        elif name == "batch":
            wanted = wanted & F.col("batch").ilike(x)
        elif name not in ("location", "allele", "marker"):
            raise ValueError(f"unknown field {name}")
    of_allele = [allele_range(fields["allele"])] if "allele" in fields else []
    if "marker" in fields:
        marker = fields["marker"]
        of_allele.append(F.col("marker_id").isin(*(marker if isinstance(marker, (list, tuple)) else [marker])))
    return wanted, reduce(Column.__and__, of_allele) if of_allele else None


def select_samples(samples: DataFrame, alleles: DataFrame | None = None, **fields) -> DataFrame:
    """Distinct sample ids for which all predicates hold in one joined row; recurrent samples never match.

    Fields: country, level1..level4 (equal), batch (case-insensitive, with % and _), location (no restriction),
    allele (see `allele_range`) and marker (ids). Alleles are joined only if one of the last two is asked for.
    """
    wanted, of_allele = _predicates(fields)
    ids = samples.filter(wanted).select("sample_id")
    if of_allele is not None:
        ids = ids.join(alleles.filter(of_allele).select("sample_id"), "sample_id", "left_semi")
    return ids.distinct()


def _leaves(tree) -> list:
    """The leaves of a set expression, in order."""
    if not isinstance(tree, tuple):
        return [tree]
    return [leaf for part in tree[1:] for leaf in _leaves(part)]


def _holds(tree, leaves: list, known: Column) -> Column:
    """The expression on the flags of a sample."""
    if not isinstance(tree, tuple):
        i = next(i for i, leaf in enumerate(leaves) if leaf is tree)
        return F.col(f"s{i}") & F.col(f"a{i}")
    verb, parts = tree[0], [_holds(t, leaves, known) for t in tree[1:]]
    counts = {"all": (0, 0), "none": (0, 0), "not": (1, 1), "exclusive": (2, 2), "union": (1, None), "intersection": (1, None)}
    if verb not in counts or len(parts) < counts[verb][0] or (counts[verb][1] is not None and len(parts) > counts[verb][1]):
        raise ValueError(f"no set expression: {verb} of {len(parts)}")
    if verb in ("all", "none"):
        return known if verb == "all" else F.lit(False)
    if verb == "not":
        return known & ~parts[0]
    if verb == "exclusive":
        return parts[0] != parts[1]
    return reduce(Column.__or__ if verb == "union" else Column.__and__, parts)


def expression_sets(trees: dict[str, tuple | dict | DataFrame], samples: DataFrame, alleles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: set_id, sample_id; dimension: set_id, label, colour) of labelled set expressions, all in one pass.

    An expression is data: a dict of fields as `select_samples` takes them, a table of ids (a saved set), or a tuple of
    ("union", x, ...), ("intersection", x, ...), ("exclusive", x, y), ("not", x), ("all",) or ("none",). Every leaf is a
    flag of a sample. Samples, the alleles that any leaf asks for and the saved sets are put under each other and shuffled
    once, by sample; the flags are merged by partial aggregates, and each expression is evaluated on them. The complement
    is against the samples of the table. A predicate that is null doesn't hold.
    """
    leaves = [leaf for tree in trees.values() for leaf in _leaves(tree)]
    fields = [_predicates(leaf) if isinstance(leaf, dict) else None for leaf in leaves]
    if any(f and f[1] is not None for f in fields) and alleles is None:
        raise ValueError("alleles are asked for, but there is no table of them")

    def flags(of_sample, of_allele, known: bool) -> list[Column]:
        sure = lambda c: F.coalesce(c, F.lit(False))
        own = [sure(of_sample(i)).alias(f"s{i}") for i in range(len(leaves))]
        return [F.col("sample_id"), F.lit(known).alias("known"), *own, *[sure(of_allele(i)).alias(f"a{i}") for i in range(len(leaves))]]

    no = lambda i: F.lit(False)
    # A leaf that asks nothing of alleles has that flag from the sample.
    rows = samples.select(*flags(lambda i: fields[i][0] if fields[i] else F.lit(False), lambda i: F.lit(bool(fields[i]) and fields[i][1] is None), True))
    asked = [i for i, f in enumerate(fields) if f and f[1] is not None]
    if asked:
        any_of = reduce(Column.__or__, [fields[i][1] for i in asked])
        rows = rows.unionByName(alleles.filter(any_of).select(*flags(no, lambda i: fields[i][1] if i in asked else F.lit(False), False)))
    for j, leaf in enumerate(leaves):
        if isinstance(leaf, DataFrame):
            rows = rows.unionByName(leaf.select(*flags(lambda i, j=j: F.lit(i == j), lambda i, j=j: F.lit(i == j), False)))
    merged = rows.groupBy("sample_id").agg(*[F.bool_or(c).alias(c) for c in rows.columns[1:]])
    sets = [F.when(_holds(tree, leaves, F.col("known")), F.lit(i)) for i, tree in enumerate(trees.values())]
    members = merged.select(F.explode(F.array_compact(F.array(*sets))).alias("set_id"), "sample_id")
    dims = [F.struct(F.lit(i).alias("set_id"), F.lit(label.strip()).alias("label"), F.lit(COLOURS[i % len(COLOURS)]).alias("colour")) for i, label in enumerate(trees)]
    return members, samples.sparkSession.range(1).select(F.inline(F.array(*dims)))


def select_expression(tree: tuple | dict | DataFrame, samples: DataFrame, alleles: DataFrame | None = None) -> DataFrame:
    """sample_id of one set expression, see `expression_sets`."""
    return expression_sets({"-": tree}, samples, alleles)[0].select("sample_id")


def all_samples(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def exclusive(a: DataFrame, b: DataFrame) -> DataFrame:
    """In one of the two but not in both, in one pass."""
    tagged = a.select("sample_id", F.lit(1).alias("tag")).union(b.select("sample_id", F.lit(2).alias("tag")))
    return tagged.groupBy("sample_id").agg(F.count_distinct("tag").alias("n")).filter("n = 1").select("sample_id")


def complement(a: DataFrame, samples: DataFrame) -> DataFrame:
    return all_samples(samples).join(a, "sample_id", "left_anti")


def saved_set(saved: DataFrame, queryset_id: int, owner: int) -> DataFrame:
    """Members of a saved set; another owner's or a missing one is empty."""
    return saved.filter((F.col("queryset_id") == queryset_id) & (F.col("owner") == owner)).select("sample_id").distinct()


def save_set(ids: DataFrame, queryset_id: int, owner: int) -> DataFrame:
    """The rows to append to the table of saved sets."""
    return ids.select(F.lit(queryset_id).alias("queryset_id"), F.lit(owner).alias("owner"), "sample_id").distinct()


def labelled(sets: dict[str, DataFrame], common: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: set_id, sample_id; dimension: set_id, label, colour) of labelled sets, each cut down to the common one."""
    parts, dims = [], []
    for i, (label, ids) in enumerate(sets.items()):
        ids = ids if common is None else ids.join(common, "sample_id", "left_semi")
        parts.append(ids.select(F.lit(i).alias("set_id"), "sample_id"))
        dims.append(F.struct(F.lit(i).alias("set_id"), F.lit(label.strip()).alias("label"), F.lit(COLOURS[i % len(COLOURS)]).alias("colour")))
    members = reduce(DataFrame.unionByName, parts)
    dim = members.sparkSession.range(1).select(F.inline(F.array(*dims)))
    return members, dim


def differentiate(members: DataFrame, samples: DataFrame, spatial: int = -1, temporal: int = 0, detection: bool = False) -> DataFrame:
    """set_id, sample_id, location, time, detection, label, source: sets split by place, time and kind of detection.

    Sets of different sources never merge; the source's own label holds only where neither place nor time splits.
    """
    time = {0: F.lit(None).cast("string"), 1: F.year("collection_date").cast("string"), 3: quarter(F.col("collection_date"))}[temporal]
    rows = members.withColumnRenamed("set_id", "source").join(samples, "sample_id").select(
        "source", "sample_id", location(spatial).alias("location"), time.alias("time"),
        (F.col("passive_detection") if detection else F.lit(None).cast("boolean")).alias("detection"),
    )
    place = F.col("location")
    own = F.when((place == "") & F.col("time").isNull(), F.col("source").cast("string")).otherwise(
        F.when(F.col("time").isNotNull(), F.concat_ws(" | ", place, "time")).otherwise(place)
    )
    kind = F.when(F.col("detection"), " PD").when(~F.col("detection"), " AD").otherwise("")
    rows = rows.withColumn("label", F.concat(short_location(F.trim(own)), kind))
    names = ("source", "location", "time", "detection")
    tags = rows.select(*names, "label").distinct()
    order = lambda r: [(r[c] is not None, r[c]) for c in ("label", *names)]  # noqa: E731  nulls first
    found = sorted(tags.collect(), key=order)  # a row a set
    numbered = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(found)], StructType([StructField("set_id", IntegerType()), *tags.schema.fields]))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in names]
    joined = rows.alias("r").join(F.broadcast(numbered.alias("t")), reduce(Column.__and__, on))
    return joined.select("t.set_id", "r.sample_id", "r.location", "r.time", "r.detection", "r.label", "r.source")


def no_samples(samples: DataFrame) -> DataFrame:
    """The empty set."""
    return samples.select("sample_id").filter("false")


def from_selector(spec: dict, samples: DataFrame, queries: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, dimension), as `labelled`, of a selector: {label: [{"batch": ..., "codes": [...]} or {"query": name}]}.

    A part takes the samples of a batch with one of the codes (of the whole batch without codes), or the named set of
    `queries`, within the batch if one is given. The label `__ALL__` is shown as '-'. Unknown queries are an error.
    """
    sets = {}
    for label, parts in spec.items():
        ids = no_samples(samples)
        for part in parts:
            if "query" in part:
                if part["query"] not in (queries or {}):
                    raise ValueError(f"unknown query {part['query']}")
                found = queries[part["query"]].select("sample_id")
                if "batch" in part:
                    found = found.join(samples.filter(F.col("batch") == part["batch"]).select("sample_id"), "sample_id", "left_semi")
            else:
                rows = samples.filter(F.col("batch") == part["batch"])
                found = (rows.filter(F.col("code").isin(*part["codes"])) if "codes" in part else rows).select("sample_id")
            ids = ids.union(found)
        sets["-" if label == "__ALL__" else label] = ids.distinct()
    return labelled(sets)


def saved_queries(saved: DataFrame, owner: int) -> DataFrame:
    """queryset_id, n of an owner's saved sets, the newest (largest id) first."""
    return saved.filter(F.col("owner") == owner).groupBy("queryset_id").agg(F.count_distinct("sample_id").alias("n")).orderBy(F.desc("queryset_id"))


def last_queries(saved: DataFrame, owner: int, n: int = 10) -> DataFrame:
    return saved_queries(saved, owner).limit(n)


def save_if_any(ids: DataFrame, queryset_id: int, owner: int) -> tuple[int, DataFrame]:
    """(count, rows to append): a set without samples is only counted, not saved."""
    n = ids.distinct().count()
    rows = save_set(ids, queryset_id, owner)
    return n, rows if n else rows.filter("false")


def paired_sets(a: DataFrame, b: DataFrame, on: str = "set_id") -> DataFrame:
    """Rows of two tables of the same sets side by side, the second's columns with `strict_`; sets that one lacks stay."""
    return a.join(b.select(on, *[F.col(c).alias(f"strict_{c}") for c in b.columns if c != on]), on, "full")


def visible(samples: DataFrame, groups, shared: str = "shared", group: str = "group_id") -> DataFrame:
    """Shared rows, and those of the groups."""
    return samples.filter(F.col(shared) | F.col(group).isin(*groups))


def page(rows: DataFrame, order: str, number: int, size: int = 300) -> DataFrame:
    return rows.orderBy(order).offset(number * size).limit(size)


def find_locations(locations: DataFrame, term: str) -> DataFrame:
    """Rows in which a level has the term."""
    levels = [F.col(c) for c in LEVELS if c in locations.columns]
    return locations.filter(F.exists(F.array(*levels), lambda x: F.coalesce(F.contains(x, F.lit(term)), F.lit(False))))


def by_code(rows: DataFrame, code: str, column: str = "code") -> DataFrame:
    """The row of a code, in any case."""
    return rows.filter(F.lower(column) == code.lower())


def main_country(members: DataFrame, samples: DataFrame) -> DataFrame:
    """The country with the most members; of equal ones the last by name."""
    counted = members.join(samples, "sample_id").groupBy("country").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.desc("country")).limit(1)
