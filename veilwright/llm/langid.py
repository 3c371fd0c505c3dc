"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes one space. N-grams of 1 to 4 code points are
hashed into ``BUCKETS`` columns. Training counts are summed by column inside each task, then over tasks.
The matrix of log-probabilities (a row a language) has a fixed number of columns; ``GROUP`` languages at a time, 16 MB, reach the driver and
are broadcast. With more languages texts are scored group by group, and each text carries its best language and the sum of
the others so far, so the number of languages has no limit. A batch
of texts is scored at once: n-grams are counted by text in sparse form and multiplied with the matrix. All languages have the same prior.

The score is the posterior of the best language with the likelihood per n-gram tempered by
``TEMPER`` n-grams, so it tells a sure prediction from a doubtful one in long texts too.

Defined cases: a null text, or one without letters, is ``und`` with score 0; without any labelled row for
training everything is ``und``; ties go to the first language by name; rows that share an id are
predicted each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.llm import _io
from veilwright.llm.wordtable import text_buffer, text_slices

BUCKETS, ORDERS, ALPHA, TEMPER, CHUNK, GROUP = 1 << 17, (1, 2, 3, 4), 0.5, 64, 1 << 18, 32
_SPACE = 32


def _fold_table() -> np.ndarray:
    """By code point below 0x3000: its lower-case form if it is one letter, else a space."""
    out = np.full(0x3000, _SPACE, np.uint32)
    for k in range(0x3000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


_FOLD = _fold_table()


def folded(points: np.ndarray) -> np.ndarray:
    """Letters in lower case, anything else a space."""
    out = _FOLD[np.minimum(points, 0x2FFF)]
    high = np.flatnonzero(points >= 0x3000)
    if len(high):
        kinds, back = np.unique(points[high], return_inverse=True)
        out[high] = np.array([ord(low) if len(low := chr(k).lower()) == 1 and chr(k).isalpha() else k if chr(k).isalpha() else _SPACE for k in kinds.tolist()], np.uint32)[back]
    return out


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: first row, then by n-gram its row and column, then by row its letters and n-grams.

    A block holds whole rows of about ``CHUNK`` characters; a longer text comes in several blocks.
    """
    buf, offsets = text_buffer(column)
    rows = len(offsets) - 1
    if not len(buf):
        return
    points = np.frombuffer(bytes(buf).decode().encode("utf-32-le"), np.uint32)
    lead = (buf & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    del lead
    row = 0
    while row < rows:
        last = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        last = min(last, rows)
        for low in range(int(at[row]), max(int(at[last]), int(at[row]) + 1), CHUNK):
            high = min(low + CHUNK, int(at[last]))
            text = folded(points[low:high])
            of = np.searchsorted(at[row : last + 1], np.arange(low, high), "right") - 1 if last - row > 1 else np.zeros(high - low, np.int64)
            yield row, last, text, of
        row = last


def hashed(text: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order: rows and columns of all n-grams that lie in one row and do not hold two spaces in a row."""
    space = text == _SPACE
    code = np.zeros(len(text), np.uint64)
    keep = np.ones(len(text), bool)
    for order in ORDERS:
        n = len(text) - order + 1
        if n <= 0:
            return
        code = code[:n] * np.uint64(0x100000001B3) + text[order - 1 :].astype(np.uint64) + np.uint64(1)
        keep = keep[:n] & ~(space[order - 1 :] & space[order - 2 : -1]) if order > 1 else ~space
        use = keep & (of[:n] == of[order - 1 :]) if order > 1 else keep
        mixed = (code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        yield of[:n][use], (mixed >> np.uint64(64 - 17)).astype(np.int64)[use]
        if order == 1:
            keep = np.ones(len(text), bool)


@dataclass(frozen=True)
class Part:
    """Some languages, in order, and their log-probabilities."""

    languages: tuple[str, ...]
    logs: np.ndarray  # languages x BUCKETS

    def totals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: the log-likelihood of each language, n-grams, letters."""
        n, k = len(column), len(self.languages)
        total, grams, letters = np.zeros((n, k)), np.zeros(n), np.zeros(n, np.int64)
        for row, last, text, of in features(column):
            letters[row:last] += np.bincount(of[text != _SPACE], minlength=last - row)
            for r, c in hashed(text, of):
                grams[row:last] += np.bincount(r, minlength=last - row)
                for j in range(k):
                    total[row:last, j] += np.bincount(r, weights=self.logs[j][c], minlength=last - row)
        return total, grams, letters


@dataclass(frozen=True)
class Standing:
    """By text: the best language so far (null: none), its log-likelihood, and the sum of all languages' odds against it."""

    best: np.ndarray
    top: np.ndarray
    odds: np.ndarray

    @classmethod
    def none(cls, n: int) -> Standing:
        return cls(np.full(n, None, object), np.full(n, -np.inf), np.zeros(n))

    def then(self, part: Part, total: np.ndarray, grams: np.ndarray) -> Standing:
        scale = TEMPER / np.maximum(grams, TEMPER)
        own = total.max(axis=1)
        odds = np.exp((total - own[:, None]) * scale[:, None]).sum(axis=1)
        top = np.maximum(self.top, own)
        best = np.where(self.top >= own, self.best, np.array(part.languages, object)[total.argmax(axis=1)])
        before = np.where(np.isfinite(self.top), self.odds * np.exp(np.where(np.isfinite(self.top), self.top - top, 0.0) * scale), 0.0)
        return Standing(best, top, before + odds * np.exp((own - top) * scale))


@dataclass(frozen=True)
class Model:
    """``counts``: lang, col, n; ``names``: lang. Both are written tables."""

    counts: DataFrame
    names: DataFrame

    def parts(self, group: int = GROUP) -> Iterator[Part]:
        """The matrix, ``group`` languages at a time in order of their names."""
        last = None
        while True:
            left = self.names if last is None else self.names.filter(F.col("lang") > last)
            names = [r.lang for r in left.orderBy("lang").limit(group).collect()]
            if not names:
                return
            counts, at = np.zeros((len(names), BUCKETS)), {x: k for k, x in enumerate(names)}
            got = self.counts.filter(F.col("lang").isin(names)).toArrow()  # at most group x BUCKETS rows
            np.add.at(counts, (np.array([at[x] for x in got.column("lang").to_pylist()], np.int64), np.asarray(got.column("col"))), np.asarray(got.column("n")))
            smooth = counts + ALPHA
            yield Part(tuple(names), np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32))
            last = names[-1]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """From all rows with a language (the values of the label column). Only sums by (language, column) leave a task, which holds those of ``GROUP`` languages."""

    def sums_of(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, x in held.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(x[at].astype(np.int64))], ["lang", "col", "n"])
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in text_slices(batches, 0):
            names = np.array(batch.column(1).to_pylist(), object)
            for row, last, text_, of in features(batch.column(0)):
                kinds = {x: k for k, x in enumerate(dict.fromkeys(names[row:last].tolist()))}
                kind = np.array([kinds[x] for x in names[row:last].tolist()], np.int64)
                for rows_, columns in hashed(text_, of):
                    of_kind = kind[rows_]
                    if len(kinds) > 1:
                        order = np.argsort(of_kind, kind="stable")
                        of_kind, columns = of_kind[order], columns[order]
                    for name, k in kinds.items():
                        own = columns[np.searchsorted(of_kind, k) : np.searchsorted(of_kind, k, "right")]
                        if not len(own):
                            continue
                        if name not in held and len(held) == GROUP:
                            yield from sums_of(held)
                        got = np.bincount(own, minlength=BUCKETS)
                        held[name] = held[name] + got if name in held else got
        yield from sums_of(held)

    labelled = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("lang is not null")
    counted = _io.stash(labelled.mapInArrow(_io.tidy(count), "lang string, col long, n long").groupBy("lang", "col").agg(F.sum("n").alias("n")), "ngrams")
    return Model(counted, _io.stash(counted.select("lang").distinct(), "languages"))


Finish = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]


def scored(rows: DataFrame, at: int, model: Model, finish: Finish, schema: T.StructType | str, group: int = GROUP) -> DataFrame:
    """``finish(batch, languages, scores)`` of all rows, whose text is column ``at``. No shuffle.

    With more than ``group`` languages the rows are written between passes, with their standing.
    """
    width = len(rows.columns)
    plain = rows.toDF(*(f"c{k}" for k in range(width)))
    between = T.StructType([*plain.schema.fields, T.StructField("best", T.StringType()), T.StructField("top", T.DoubleType()), T.StructField("odds", T.DoubleType())])

    def scan(part: Part | None, first: bool, last: bool) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast(part)  # at most group x BUCKETS floats

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, at):
                n, part = batch.num_rows, held.value
                if first:
                    now = Standing.none(n)
                else:
                    now = Standing(np.array(batch.column(width).to_pylist(), object), np.asarray(batch.column(width + 1).fill_null(0)), np.asarray(batch.column(width + 2).fill_null(0)))
                letters = np.zeros(n, np.int64)
                if part is not None:
                    total, grams, letters = part.totals(batch.column(at))
                    now = now.then(part, total, grams) if n else now
                columns = [batch.column(k) for k in range(width)]
                if last:
                    known = letters > 0
                    names, sure = np.where(known, now.best, "und"), np.where(known, 1 / np.where(now.odds > 0, now.odds, 1), 0.0)
                    yield finish(pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(width)]), names, sure)
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(now.best.tolist(), pa.string()), pa.array(now.top), pa.array(now.odds)], names=between.fieldNames())

        return plain.mapInArrow(_io.tidy(work), schema if last else between)

    parts = model.parts(group)
    part, first = next(parts, None), True
    while (after := next(parts, None)) is not None:
        plain, part, first = _io.stash(scan(part, first, False), "standing"), after, False
    return scan(part, first, True)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, lang_pred, score for every row."""

    def finish(batch: pa.RecordBatch, names: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    return scored(_io.text_rows(docs, key, text), 1, model, finish, "doc_id long, lang_pred string, score double", group)


def keep_known(docs: DataFrame, model: Model, least: float, text: str = "text", group: int = GROUP) -> DataFrame:
    """The rows, with all their columns, whose text has a language with a score of ``least`` or more."""

    def finish(batch: pa.RecordBatch, names: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array((names != "und") & (sure >= least)))

    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)])
    return scored(docs, docs.columns.index(text), model, finish, plain, group).toDF(*docs.columns)


def held_out(key: str = "doc_id"):
    """Rows that no training may see: a quarter, by checksum of the id."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == 2, F.lit(False))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.read(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
