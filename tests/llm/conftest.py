import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Nulls in every column, empty, blank and long texts, ties, repeats, other scripts, clashing names.
EDGE_TEXTS = [
    None, "", " ", "\n\t ", "one", "two words", "The quick brown fox jumps over the lazy dog", "THE QUICK brown fox jumps over the lazy dog",
    "!!! ... ???", "12345 67890", "中文 文本 没有 空格的句子", "é" * 300, "word " * 4000, "x" * 20_000, "a  b   c \u2581 d", "naïve café — “quoted” 🙂 end",
    "Licensed under the MIT License. Copyright 2020, all rights reserved.", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "same text here", "same text here",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Rows of all kinds, a repeated row, a null id and extra columns whose names clash with those of the operators."""
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(18, "same text here", None, None, None), (None, "no id at all", "en", "s", 3)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("score", "fp", "ids", "rank", "host", "length", "label"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
