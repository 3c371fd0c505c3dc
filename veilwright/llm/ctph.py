"""Context-triggered piecewise hashing: fingerprints that survive edits.

A hash of the last seven bytes triggers chunk ends wherever it is -1 modulo the block size. Each chunk
gives one of 64 characters; the signature at a block size is the string of them. The block size is
the power of two times ``LEAST`` for which a text has about ``LENGTH`` chunks, and the signature at
twice that size is kept as well, so texts whose block sizes differ by one step can be compared.
A fingerprint reads ``block:signature:signature at twice the block``.

Signatures of one block size are compared by edit distance (insert and delete cost 1, replace 2),
which is worked out a row at a time on integers used as bit vectors. Runs of a character longer than
three are cut to three first, and signatures without ``COMMON`` characters in a row in common score 0.

Defined cases: a null text counts as empty (fingerprint ``3::``); two empty texts have likeness 1; equal
texts have equal fingerprints; rows that share an id are ordered by a hash of their text and each has
a next one; a lone row's next document is itself; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.llm import _io

LEAST, LENGTH, COMMON, REACH = 3, 64, 7, 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUN = re.compile(r"(.)\1{3,}")


def _rolling(buf: np.ndarray) -> np.ndarray:
    """The hash of the last seven bytes at each place (fewer at the start)."""
    n = len(buf)
    wide = buf.astype(np.uint32)
    padded = np.concatenate([np.zeros(REACH, np.uint32), wide])
    total = np.cumsum(padded, dtype=np.uint32)
    h1 = total[REACH:] - total[:n]
    h2, h3 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for age in range(REACH):
        own = padded[REACH - age : REACH - age + n]
        h2 += own * np.uint32(REACH - age)
        h3 ^= own << np.uint32(5 * age)
    return h1 + h2 + h3


def _block(n: int) -> int:
    block = LEAST
    while block * LENGTH < n:
        block *= 2
    return block


def _signature(hits: np.ndarray, sums: np.ndarray, n: int) -> str:
    """One character for each chunk; ``sums``: running sums of mixed bytes, so chunks are hashed at once."""
    ends = np.append(hits + 1, n) if not len(hits) or hits[-1] + 1 < n else hits + 1
    if not n:
        return ""
    total = sums[ends]
    h = np.diff(np.concatenate([sums[:1], total])) * _MIX
    h ^= np.diff(np.concatenate([[0], ends])).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return _ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


_BYTE_MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def fingerprint(raw: bytes) -> str:
    n = len(raw)
    if not n:
        return f"{LEAST}::"
    buf = np.frombuffer(raw, np.uint8)
    roll = _rolling(buf)
    # each byte weighs by the two before it, so that order within a chunk counts
    mixed = _BYTE_MIX[buf]
    mixed[1:] ^= _BYTE_MIX[buf[:-1]] << np.uint64(1)
    mixed[2:] ^= _BYTE_MIX[buf[:-2]] >> np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    block = _block(n)
    while True:
        hits = np.flatnonzero(roll % np.uint32(block) == block - 1)
        if len(hits) >= LENGTH // 2 or block == LEAST:
            break
        block //= 2
    while len(hits) > 2 * LENGTH:  # one pattern over and over: take only places that trigger larger blocks
        block *= 2
        hits = np.flatnonzero(roll % np.uint32(block) == block - 1)
    twice = hits[roll[hits] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(hits, sums, n)}:{_signature(twice, sums, n)}"


def edit_likeness(a: str, b: str) -> float:
    """1 less the edit distance (replace costs 2) over both lengths; 0 without a common run."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = _RUN.sub(r"\1\1\1", a), _RUN.sub(r"\1\1\1", b)
    if min(len(x), len(y)) >= COMMON:
        runs = {x[k : k + COMMON] for k in range(len(x) - COMMON + 1)}
        if not any(y[k : k + COMMON] in runs for k in range(len(y) - COMMON + 1)):
            return 0.0
    at: dict[str, int] = {}
    for k, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(x)) - 1
    rest = full  # zero bits: steps of the longest common subsequence
    for c in y:
        u = rest & at.get(c, 0)
        rest = ((rest + u) | (rest - u)) & full
    common = len(x) - rest.bit_count()
    return 2 * common / (len(x) + len(y))


def likeness(a: str, b: str) -> float:
    """0 to 1, for two fingerprints; 0 where no block size is shared."""
    if a == b:
        return 1.0
    (p, x1, x2), (q, y1, y2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(edit_likeness(x1, y1), edit_likeness(x2, y2))
    if p == 2 * q:
        return edit_likeness(x1, y2)
    if q == 2 * p:
        return edit_likeness(x2, y1)
    return 0.0


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many from the start of another text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(key: int | None, text: str, mark: str, after: str, after_mark: str) -> dict:
    new = edited(text, after).encode()
    new_mark = fingerprint(new)
    return {"doc_id": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(new).hexdigest(), "fingerprint": mark, "edited_fingerprint": new_mark, "near_edited": likeness(mark, new_mark), "near_next": likeness(mark, after_mark)}


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint for every row; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.encode()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return _io.text_rows(docs, key, text).mapInArrow(_io.tidy(work), "doc_id long, fingerprint string")


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against its edited form and against the next document by id (the first after the last).

    Texts are dealt out once, by ranges of the id. The last text of a partition needs the first of
    the next one: each partition passes on these two, and a second, small step joins them.
    """
    schema = _RESULT + ", pid long, edge string, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last = TaskContext.get().partitionId(), None
        kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("pid", pa.int64()), ("edge", pa.string()), ("text", pa.string())])
        for batch in batches:
            rows = []
            for one, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = fingerprint(own.encode())
                if last is None:
                    rows.append({"doc_id": one, "fingerprint": mark, "pid": pid, "edge": "first", "text": own})
                else:
                    rows.append(_row(*last, own, mark) | {"pid": pid})
                last = one, own, mark
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        if last:
            yield pa.RecordBatch.from_pylist([{"doc_id": last[0], "fingerprint": last[2], "pid": pid, "edge": "last", "text": last[1]}], schema=kinds)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(x["doc_id"], x["text"], x["fingerprint"], x["after"], x["after_fingerprint"]) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([]))

    ordered = _io.text_rows(docs, key, text).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    out = _io.stash(ordered.mapInArrow(_io.tidy(work), schema), "quarters")
    done = out.filter("edge is null").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    order = Window.orderBy("pid")  # two rows a partition
    first = out.filter("edge = 'first'").select(F.row_number().over(order).alias("k"), F.col("text").alias("after"), F.col("fingerprint").alias("after_fingerprint"))
    last = out.filter("edge = 'last'").select(F.row_number().over(order).alias("n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("all"), "doc_id", "text", "fingerprint")
    edges = last.withColumn("k", F.col("n") % F.col("all") + 1).join(first, "k").select("doc_id", "text", "fingerprint", "after", "after_fingerprint")
    return done.unionByName(edges.mapInArrow(_io.tidy(close), _RESULT))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(_io.read(spark, sf_dir, "documents"))
