"""A corpus pipeline: language ID, exact dedup, near dedup, passage dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``, and further columns, whatever their names, come through unchanged.

Defined cases: null and empty texts, and texts without letters, go in the first stage (they have no
language); of rows that share id and text one stays; a null id counts as the largest; an empty table
gives no rows at any stage; nulls in other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import _io, exact_dedup, langid, packing, queries, simhash, suffix_dedup

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts that no language fits with a score of ``LEAST_SCORE``, go.

    Labelled rows train the model. A document is told by id and text, so rows that share an id are
    judged each by its text.
    """
    return langid.keep_known(docs, langid.train(docs), LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z case) the row of the largest id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles) the row of the least id stays."""
    return simhash.keep_one(docs, width=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that an earlier document has are cut; rows of which nothing is left go."""
    return suffix_dedup.cut(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 tokens: the pieces of documents in them."""
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"), 1)


STAGES = [("language", language), ("exact", exact), ("near", near), ("passages", passages), ("packing", packed)]

#: No SQL for fingerprints by majority, passage cuts by suffixes, or packing: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own tables go when its result is written, and that when the next one's is."""
    docs, last = _io.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = _io.scratch(spark, name)
        with _io.temporary():
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _io.release([last])
        last = path
    return docs
