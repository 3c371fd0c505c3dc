"""Scan plans: texts, files or trees to findings."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions.spans import let
from veilwright.functions.text import Body, stripped, with_pages
from veilwright.operators import ascii_scan
from veilwright.operators.detectors import classified, with_findings
from veilwright.options import FINDING, ScanOptions
from veilwright.sources import files


def explode_findings(texts: DataFrame, body: Body, fields: Iterable[str] | None = None) -> DataFrame:
    """One row a finding, with its text, place and context; ``texts`` has file, text, pages and found.

    ``fields``: the columns that are wanted; only these are worked out. Everything is worked out inside the row, so no copy of a text is made for each finding.
    """

    wanted = [c for c in FINDING.fieldNames() if c == "file" or fields is None or c in fields]

    def placed(x: Column) -> Column:
        own = [body.part(x["start"], x["end"]).alias("value")] if "text" in wanted else []
        return let(F.struct(*own, x.alias("x")), shown) if own else shown({"x": x, "value": F.lit("")})

    def shown(o: Column | dict[str, Column]) -> Column:
        x, value = o["x"], o["value"]
        text = F.when(x["source"] == "unknown_name_heuristic", F.translate(value, "’", "'")).when(x["source"] == "regex", stripped(value)).otherwise(value)
        own = {
            "entity_type": x["entity_type"], "text": text, "start": x["start"], "end": x["end"], "line_no": body.line_no(x["start"]), "col_no": (x["start"] - body.line_begin(x["start"]) + 1).cast("int"),
            "confidence": x["confidence"], "context": body.context(x["start"], x["end"]), "source": x["source"],
        }
        return F.struct(*(value.alias(name) for name, value in own.items() if name in wanted))

    # the outer form: for the inner one Spark would put a filter before it that works all findings out again
    found = F.transform("found", placed)
    if "done" in texts.columns:
        found = F.when(F.col("done"), F.col("own")).otherwise(found)
    rows = texts.select("file", F.explode_outer(found).alias("x")).filter("x is not null")
    out = rows.select("file", "x.*")
    return (out.filter("text <> ''") if "text" in wanted else out).select(*wanted)


def recognize(texts: DataFrame, recognizer) -> DataFrame:
    """With ``recognized``: spans of persons by ``recognizer(text) -> [(start, end, score)]``.

    The recognizer runs in Arrow batches; a text on which it fails has no spans.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def safe(text: str | None) -> list[dict]:
        try:
            return [{"start": a, "end": b, "score": s} for a, b, s in recognizer(text or "")]
        except Exception:  # a failing recognizer must not end the scan
            return []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([safe(x) for x in batch.column(1).to_pylist()], kind)], ["file", "text", "recognized"])

    return texts.select("file", "text").mapInArrow(work, "file string, text string, recognized array<struct<start:int,end:int,score:double>>")


def scan(texts: DataFrame, options: ScanOptions, fields: Iterable[str] | None = None) -> DataFrame:
    """Findings of ``texts`` (file, text), disjoint in each file. No shuffle: all order is inside a row.

    ``fields``: the columns of a finding that are wanted, all if not given. With a roster, findings (not texts) are joined to it.
    """
    recognized, wanted = None, {*FINDING.fieldNames()} if fields is None else {*fields}
    if options.roster is not None:
        wanted |= {"entity_type", "text"}
    if ascii_scan.covers(options):
        texts = ascii_scan.with_done(texts, options, [c for c in FINDING.fieldNames() if c in wanted and c != "file"])
    if options.recognizer is not None and "NAME" in options.entities:
        texts, recognized = recognize(texts, options.recognizer), "recognized"
    texts, body = with_pages(texts)
    found = explode_findings(with_findings(texts, body, options, recognized), body, wanted)
    return found if options.roster is None else classified(found, options.roster)


def scan_path(spark: SparkSession, root: str, options: ScanOptions, skip: Iterable[str] = (), without: Iterable[str] = ()) -> DataFrame:
    """Findings of all text files below a folder, or of one file. ``skip``: folders, ``without``: files to leave out."""
    return scan(files.texts(spark, root, skip, without), options)


def scan_file(spark: SparkSession, path: str, options: ScanOptions, root: str | None = None) -> DataFrame:
    """Findings of one file, whatever its suffix; it is named by its place below ``root`` (without: by its own name)."""
    name = os.path.relpath(os.path.realpath(path), os.path.realpath(root)) if root else os.path.basename(path)
    return scan(files.one_text(spark, path, name.replace(os.sep, "/")), options)
