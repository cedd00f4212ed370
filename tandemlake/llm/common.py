"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import cut, discard, release, shared_folder  # noqa: F401  of the text operators

#: Rows that a mapper handles at a time; texts may be long, so batches are cut small.
SLICE_ROWS = 256
#: Bytes of an Arrow batch on its way to Python, about: rows of long texts are sent a few at a time.
BATCH_BYTES = 4 << 20
_HELD: dict[str, Any] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text column, a null being the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_ascii(column: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_fold(column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo `parts`; null ids fall in a fold of their own (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session take BATCH_BYTES at most, or what was set if that is less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def held(name: str, make: Callable[[], Any]) -> Any:
    """What takes long to load, kept in a Python worker from task to task, one thing at a time: a worker serves all
    stages, and would else keep what each of them loaded."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def let_go(but: str | None = None) -> None:
    """Drop what is held, except for one name."""
    for name in [n for n in _HELD if n != but]:
        del _HELD[name]


def give_back() -> None:
    """Let the system have the memory that a finished task used: Spark keeps its process for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def map_columns(
    df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, list]], setup: Callable[[], None] | None = None, holds: str | None = None
) -> DataFrame:
    """Run `work` over slices of a few hundred rows in Arrow: columns as lists in, columns as lists out.

    Slices and small batches keep memory bounded, however many rows a partition has. holds: the name of what `work`
    has from `held`; the worker drops anything else.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    out_schema = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(holds)
        if setup:
            setup()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                got = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out_schema], schema=out_schema)
        give_back()

    return df.mapInArrow(run, schema)
