"""The corpus pipeline: quality, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame, which
`run` writes as Parquet and reads again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.llm import langid, packing, quality, secrets, simhash
from tandemlake.llm.common import cut, discard, read_table, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Pooled probability of the predicted language below which a document has no clear language.
LANGUAGE_SCORE = 0.3
#: Words that packing remembers: its Python workers are those of the other stages too, and keep what these loaded.
MEMO_WORDS = 200_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good. It learns from all labelled documents of the corpus but the
    held-out fold; documents it rejects go.

    Null, empty and blank texts have the score of the calibration's bias and stay or go with it. Rows that repeat an id
    are scored each by its own text, and a null id is as good as any. An empty table stays empty.
    """
    corpus = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(corpus, read_table(spark, sf_dir, "labels"), ~quality.held_out())
    scored = quality.score_quality(docs.select(*COLUMNS), model, keep=("text", "lang", "source", "n_chars"))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language; those predicted `und`, or of no language with a probability of at least
    LANGUAGE_SCORE, go.

    So null, empty and letterless texts go. The column lang is only learned from and stays as it is, nulls included.
    Repeated rows and null ids are kept or go by their texts. An empty table stays empty.
    """
    model = langid.train_languages(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~langid.held_out())
    scored = langid.predict_languages(docs.select(*COLUMNS), model, keep=("text", "lang", "source", "n_chars"))
    return scored.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with a similarity of 0.8 or more on five-word shingles: that with the smallest
    id, null ids last, and of rows with one id in a class that with the smallest text. An id that repeats with unrelated
    texts stays with each."""
    rows = cut(simhash.similar_rows(docs.select("doc_id", "text")))
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("id"))
    named = cut(rows.join(first, "class").filter(F.col("doc_id").eqNullSafe(F.col("id.doc_id"))).select("class", simhash.row_name().alias("row")).distinct())
    several = named.groupBy("class").agg((F.count("*") > 1).alias("tied"))
    kept = cut(named.join(several, "class"))
    discard(rows, named)
    named_docs = docs.select(*COLUMNS, simhash.text_digest().alias("digest")).withColumn("row", simhash.row_name()).drop("digest")
    best = kept.filter("NOT tied").select("row")
    tied = kept.filter("tied")
    if not tied.isEmpty():
        texts = named_docs.select("row", "text").join(tied, "row").groupBy("class").agg(F.min(F.struct("text", "row")).alias("least"))
        best = best.unionByName(texts.select("least.row"))
    # Rows that repeat id and text are one.
    rest = F.min(F.struct(*COLUMNS)).alias("rest")
    return named_docs.join(best, "row").groupBy("row").agg(rest).select("rest.*")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars counted anew."""
    hidden = secrets.mask_secrets(docs.select(*COLUMNS))
    return hidden.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences, with the ids that a trainer reads.

    Null and empty texts are the end id alone; rows that repeat an id, and those without one, are packed each for itself.
    An empty table has no pieces.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, memo_words=MEMO_WORDS)


STAGES = (
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("packing", pack),
)

#: Trained models, tree searches and tokenizers can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
