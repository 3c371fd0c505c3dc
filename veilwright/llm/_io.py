"""What the operators share: rows of key and text, and rows that stay. Tables between steps are written to the shared folder."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.sources.shared import release, scratch, stash, temporary

__all__ = ["keep_rows", "read", "release", "scratch", "stash", "temporary", "text_rows", "tidy"]

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(work: Work) -> Work:
    """``work`` for ``mapInArrow``, that gives freed memory back to the system every second and at its end.

    Workers are reused, and the C library otherwise keeps what large arrays took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)
        last = time.monotonic()
        for out in work(batches):
            yield out
            if time.monotonic() - last > 1:
                del out
                trim(0)
                last = time.monotonic()
        pa.default_memory_pool().release_unused()
        trim(0)

    return run


def text_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text (null: empty), whatever else the table holds or how it is named."""
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep_rows(docs: DataFrame, found: DataFrame, key: str, mark: Column) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``found`` (doc_id, mark, n) names by id and ``mark``, each once.

    ``found`` has each (doc_id, mark) once and ``n``, the number of rows that have it. Rows are only gathered
    by (id, mark) where some are repeated.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{key}`").cast("long").alias("k"), mark.alias("m"))
    joined = rows.join(found, (rows.m == found.mark) & rows.k.eqNullSafe(found.doc_id)).select("row", "k", "m", "n")
    if found.filter("n > 1").isEmpty():
        return joined.select("row.*")
    return joined.filter("n = 1").select("row.*").unionByName(joined.filter("n > 1").groupBy("k", "m").agg(F.first("row").alias("row")).select("row.*"))
