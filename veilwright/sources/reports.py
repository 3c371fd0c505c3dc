"""Report sinks: findings as JSON, names and maps as CSV, and console listings."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veilwright.fixed import FINDING_FIELDS, MAP_FIELDS, NAME_FIELDS


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings without offsets, in report order, under the names of reports."""
    return findings.withColumnsRenamed({"line_no": "line", "col_no": "column"}).orderBy("file", "start", "end").select(*FINDING_FIELDS)


def folder_of(file: Column) -> Column:
    return F.regexp_extract(file, "^(.*)/[^/]*$", 1)


def name_rows(findings: DataFrame) -> DataFrame:
    folder = folder_of(F.col("file"))
    own = findings.filter("entity_type = 'NAME'").orderBy("file", "start", "end")
    return own.select(F.col("text").alias("name"), folder.alias("folder"), "file", F.col("line_no").alias("line"), F.col("col_no").alias("column"), F.format_string("%.4f", "confidence").alias("confidence"), "source", *(c for c in findings.columns if c == "context"))


def write_json(findings: DataFrame, path: str) -> None:
    """One array; rows pass the driver one partition at a time. For large results use :func:`write_json_lines`."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for k, row in enumerate(report_rows(findings).toLocalIterator()):
            body = json.dumps(row.asDict(), indent=2, ensure_ascii=False)
            f.write(("," if k else "") + "\n  " + body.replace("\n", "\n  "))
        f.write("\n]" if "row" in locals() else "]")


def write_json_lines(findings: DataFrame, path: str) -> None:
    report_rows(findings).write.mode("overwrite").json(path)


def _write_csv(rows: Iterator[Row], fields: tuple[str, ...], path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(fields)
        for row in rows:
            out.writerow(["" if row[c] is None else row[c] for c in fields])


def write_names_csv(findings: DataFrame, path: str) -> None:
    _write_csv(name_rows(findings).toLocalIterator(), NAME_FIELDS, path)


def write_map(mapping: DataFrame, path: str) -> None:
    """The review table, in order."""
    _write_csv(mapping.orderBy("index").toLocalIterator(), MAP_FIELDS, path)


def summary(root: str, findings: DataFrame, mapping: DataFrame) -> Iterator[str]:
    yield f"Input: {root}"
    yield f"Findings: {findings.count()}"
    entity = None
    for r in mapping.orderBy("index").toLocalIterator():
        if r.entity_type != entity:
            entity = r.entity_type
            yield f"\n[{entity}]"
        yield f"{r['index']:>5}. {r.original}  hits={r.hits}  locations={r.locations}"


def name_table(root: str, findings: DataFrame) -> Iterator[str]:
    rows = name_rows(findings)
    yield f"Input: {root}"
    yield f"Names found: {rows.count()}"
    for k, r in enumerate(rows.toLocalIterator()):
        if not k:
            yield "\n" + " | ".join(("Name", "Folder", "File", "Line", "Column", "Source"))
        yield " | ".join(map(str, (r.name, r.folder, r.file, r.line, r.column, r.source or "unknown")))
