"""One import: documents are checked against what is stored, and the tables as they are after it are returned.

Nothing is changed in place. Rules come first, as anti- and semi-joins; only an import without any error makes new tables.
Alleles are never overwritten: an import's alleles have its revision, and the latest one of a sample's marker counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tabular import collection_date, import_errors, stored_alleles
from ..storage import cut, discard
from .store import merge

FIELDS = ("country", "level1", "level2", "level3", "level4")
SAMPLE = "batch string, code string, collection_date date, country string, level1 string, level2 string, level3 string, level4 string, comments string"
ALLELE = (
    "batch string, revision int, sample string, assay string, marker string, panel string, dye string, pos int, value int, size double, height int, area int, "
    "peak_type string, method string"
)


@dataclass(frozen=True)
class Stored:
    """The tables of an archive: batches (code), samples (SAMPLE), alleles (ALLELE) and markers (code)."""

    batches: DataFrame
    samples: DataFrame
    alleles: DataFrame
    markers: DataFrame


def document_samples(docs: DataFrame, batch: str) -> DataFrame:
    """The samples of documents (code, doc), a row a code: of repeated codes the least document. Fields that a document
    lacks are null."""
    one = docs.groupBy("code").agg(F.min("doc").alias("doc"))
    read = one.select("code", F.from_json("doc", "collection_date string, location array<string>, comments string").alias("x"))
    places = [F.lower(F.get("x.location", F.lit(i))).alias(c) for i, c in enumerate(FIELDS)]
    date = F.when(F.col("x.collection_date").isNotNull(), collection_date(F.col("x.collection_date")))
    return read.select(F.lit(batch).alias("batch"), "code", date.alias("collection_date"), *places, F.col("x.comments").alias("comments"))


def import_documents(docs: DataFrame, batch: str, stored: Stored, mode: str = "new") -> tuple[Stored, DataFrame]:
    """(tables after the import, errors) of documents (code, doc) that go into a batch.

    `new` stores a batch with its samples and alleles, `sample` adds samples that a stored batch lacks, with their
    alleles, `allele` adds alleles to stored samples as their latest, and `info` changes fields of stored samples, those
    that a document has. With any error (see `import_errors`) the tables are as before.
    """
    docs = cut(docs.select("code", "doc"))  # read by every rule and every table
    alleles = cut(stored_alleles(docs)) if mode != "info" else None  # documents are parsed once
    errors = cut(import_errors(docs, batch, stored.batches, stored.samples, stored.markers, mode, alleles))
    if not errors.isEmpty():
        if alleles is not None:
            discard(alleles)
        return stored, errors
    given = document_samples(docs, batch)
    after = stored
    if mode == "new":
        row = docs.sparkSession.range(1).select(F.lit(batch).alias("code"))
        after = replace(after, batches=stored.batches.select("code").unionByName(row))
    if mode in ("new", "sample"):
        after = replace(after, samples=stored.samples.unionByName(given))
    elif mode == "info":
        # A batch is named in any case; its rows keep their own spelling.
        mine = F.lower("batch") == batch.lower()
        changed = merge(stored.samples.filter(mine).drop("batch"), given.drop("batch"), ["code"])
        names = stored.samples.filter(mine).select("code", "batch")
        after = replace(after, samples=stored.samples.filter(~mine).unionByName(changed.join(names, "code")))
    if mode != "info":
        last = stored.alleles.filter(F.lower("batch") == batch.lower()).agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]
        rows = alleles.select(F.lit(batch).alias("batch"), F.lit(last + 1).alias("revision"), *[F.col(c.split()[0]).cast(c.split()[1]) for c in ALLELE.split(", ")[2:]])
        after = replace(after, alleles=stored.alleles.unionByName(rows))
    return after, errors


def latest_alleles(stored: Stored) -> DataFrame:
    """The alleles that count: of a sample's marker those of its latest revision."""
    keys = [F.lower("batch").alias("b"), F.col("sample").alias("s"), F.lower("marker").alias("m")]
    last = stored.alleles.groupBy(*keys).agg(F.max("revision").alias("r"))
    on = (F.lower("batch") == F.col("b")) & (F.col("sample") == F.col("s")) & (F.lower("marker") == F.col("m")) & (F.col("revision") == F.col("r"))
    return stored.alleles.join(last, on).drop("b", "s", "m", "r")


def empty(spark, markers: DataFrame) -> Stored:
    """An archive without batches."""
    return Stored(spark.createDataFrame([], "code string"), spark.createDataFrame([], SAMPLE), spark.createDataFrame([], ALLELE), markers)
