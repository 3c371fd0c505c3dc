"""Exact deduplication by content-defined chunk recipes.

Each text, lower-cased in A-Z only, is cut where a rolling hash of its last ``WINDOW`` bytes hits a
pattern. A document becomes a recipe: the ordered identifiers of its chunks. Only chunks move, each
distinct one once from a task: all bodies under one identifier are compared (least against
greatest), so an identifier stands for one body, verified. If two bodies ever share an identifier,
the recipes are made again with the next, longer identifier. Documents are equal when their recipes
are, and long documents are compared by lists of 16 bytes a chunk.

Defined cases: a null text counts as empty; of equal texts the row with the largest id stays (a null
id only if no other is there); rows that share an id and a text count each and are kept together;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import _io
from veilwright.llm.wordtable import text_buffer, text_slices

WINDOW, MASK, LEAST, MOST = 32, (1 << 12) - 1, 1024, 16384
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)

Identify = Callable[[bytes], bytes]


def short_id(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def long_id(body: bytes) -> bytes:
    return hashlib.sha512(body).digest()


def rolling(buf: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of each run of ``window`` (a power of two) bytes, at the place behind it less one."""
    h, span, factor = _SEEDS[buf], 1, 0x9E3779B97F4A7C15
    while span < window:
        out = h.copy()
        out[span:] += h[:-span] * np.uint64(factor)
        h, span, factor = out, span * 2, factor * factor % 2**64
    return h


def cuts(buf: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each row. Only a row's own bytes decide on them."""
    out = []
    hot = np.flatnonzero((rolling(buf) >> np.uint64(40)) & np.uint64(MASK) == 0) + 1 if len(buf) else np.zeros(0, np.int64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, at = [], a
        if b - a > LEAST:
            for cut in hot[np.searchsorted(hot, a + max(LEAST, WINDOW)) : np.searchsorted(hot, b)].tolist():
                while cut - at > MOST:
                    at += MOST
                    ends.append(at)
                if cut - at >= LEAST:
                    at = cut
                    ends.append(at)
            while b - at > MOST:
                at += MOST
                ends.append(at)
        if at < b:
            ends.append(b)
        out.append(ends)
    return out


def _recipes(docs: DataFrame, identify: Identify) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            buf, offsets = text_buffer(batch.column(1))
            raw = memoryview(_LOWER[buf].tobytes())
            recipe, sha = [], []
            for a, b, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cuts(np.frombuffer(raw, np.uint8), offsets), strict=True):
                recipe.append(b"".join(identify(raw[x:y]) for x, y in zip([a, *ends], ends, strict=False)))
                sha.append(hashlib.sha256(raw[a:b]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipe, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return docs.mapInArrow(_io.tidy(work), "doc_id long, recipe binary, text_sha256 string")


def _chunks(docs: DataFrame, identify: Identify) -> DataFrame:
    """id, body: each distinct chunk once a slice of the input."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            buf, offsets = text_buffer(batch.column(0))
            raw = _LOWER[buf].tobytes()
            own = {raw[x:y] for a, ends in zip(offsets[:-1].tolist(), cuts(np.frombuffer(raw, np.uint8), offsets), strict=True) for x, y in zip([a, *ends], ends, strict=False)}
            bodies = list(own)
            yield pa.RecordBatch.from_arrays([pa.array([identify(x) for x in bodies], pa.binary()), pa.array(bodies, pa.binary())], ["id", "body"])

    return docs.select("text").mapInArrow(_io.tidy(work), "id binary, body binary")


def verified_recipes(docs: DataFrame, ladder: Sequence[Identify] = (short_id, long_id)) -> DataFrame:
    """doc_id, recipe, text_sha256, with identifiers of which each stands for one body."""
    for identify in ladder:
        bodies = _chunks(docs, identify).groupBy("id").agg(F.min("body").alias("least"), F.max("body").alias("most"))
        if bodies.filter("least <> most").isEmpty():
            return _io.stash(_recipes(docs, identify), "recipes")
    raise ValueError("different chunks share the longest identifier")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", ladder: Sequence[Identify] = (short_id, long_id)) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    recipes = verified_recipes(_io.text_rows(docs, key, text), ladder)
    groups = _io.stash(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    joined = recipes.join(groups, "recipe")  # a hot group is split by AQE: both sides are plain scans
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that share id and text, one."""
    stay = duplicates(docs, key, text).filter("kept").groupBy("doc_id", F.col("text_sha256").alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    lowered = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _io.keep_rows(docs, _io.stash(stay, "stay"), key, F.sha2(lowered, 256))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(_io.read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
