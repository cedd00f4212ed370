"""Changes to stored tables as new tables: merge by field presence, deletes that cascade, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DOMAINS


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, non-null (and non-empty) new fields replace the old ones.

    Both have the same columns; `new` has at most one row for a key.
    """
    fields = [c for c in old.columns if c not in keys]
    kinds = dict(old.dtypes)
    new = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    picked = [F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"_new_{c}"), F.col(c)).alias(c) for c in fields]
    return old.join(new, keys, "full").select(*keys, *picked).select(*old.columns)


def insert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not stored yet, to append; of rows with one key the least by all columns, nulls first."""
    rest = [c for c in new.columns if c not in keys]
    one = new.join(old.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row") if rest else F.lit(None).alias("_row"))
    return one.select(*keys, *([F.col(f"_row.{c}").alias(c) for c in rest])).select(*new.columns)


def existing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in both: an error for an insert, needed for an update."""
    return new.select(*keys).distinct().join(old, keys, "left_semi")


def delete(tables: dict[str, DataFrame], gone: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables without the rows `gone` (of the first link's parent, by its key) and what hangs on them.

    links: (parent, parent key, child, child's column for it), parents first.
    """
    out, lost = dict(tables), {links[0][0]: gone}
    parent, key = links[0][0], links[0][1]
    out[parent] = out[parent].join(gone.select(key), key, "left_anti").select(*tables[parent].columns)
    for parent, key, child, column in links:
        if parent in lost:
            ids = lost[parent].select(F.col(key).alias(column)).distinct()
            lost[child] = tables[child].join(ids, column, "left_semi")
            out[child] = out[child].join(ids, column, "left_anti").select(*tables[child].columns)
    return out


def outside_domain(rows: DataFrame, column: str, domain: str | None = None) -> DataFrame:
    """Rows whose column has none of its domain's values: an error of the rows. Nulls are none."""
    values = DOMAINS[domain or column]
    return rows.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def published(rows: DataFrame, ids: list[int], key: str, flag: str = "published") -> DataFrame:
    return rows.withColumn(flag, F.col(flag) | F.col(key).isin(*ids))


def snapshot(rows: DataFrame, members: DataFrame, uid: str, key: str = "alleleset_id") -> DataFrame:
    """The rows that belonged to a version; members: uid and key."""
    return rows.join(members.filter(F.col("uid") == uid).select(key), key, "left_semi")
