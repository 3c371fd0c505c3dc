"""Splicing chosen replacements into texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.spans import let
from veilwright.functions.text import Body, with_pages
from veilwright.operators.groups import keyed

EDITS = "array<struct<start:int,end:int,replacement:string>>"


def spliced(body: Body, edits: Column) -> Column:
    """The text with disjoint edits (any order), on offsets of the original."""

    def pieces(own: Column) -> Column:
        since = lambda k: F.when(k > 0, F.get(own, k - 1)["end"]).otherwise(0)
        changed = F.transform(own, lambda e, k: F.concat(body.part(since(k), e["start"]), e["replacement"]))
        rest = F.substring(body.text, F.coalesce(F.get(own, F.size(own) - 1)["end"], F.lit(0)) + 1, F.length(body.text))
        return F.concat(F.array_join(changed, ""), rest)

    return F.when(F.size(edits) > 0, let(F.array_sort(edits), pieces)).otherwise(body.text)


def edits_by_file(findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """file, edits: the findings that have a replacement. ``mapping``: entity_type, key, replacement."""
    chosen = mapping.filter(F.coalesce("replacement", F.lit("")) != "").select("entity_type", "key", "replacement")
    rows = keyed(findings).select("file", "entity_type", "key", "start", "end").join(chosen, ["entity_type", "key"])
    return rows.groupBy("file").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))


def with_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """file, text, replacements (number of splices) for every text; ``edits`` is that of :func:`edits_by_file`."""
    own, body = with_pages(texts)
    own = own.join(edits, "file", "left").withColumn("edits", F.coalesce("edits", F.array().cast(EDITS)))
    return own.select("file", spliced(body, F.col("edits")).alias("text"), F.size("edits").alias("replacements"))


def apply_map(texts: DataFrame, findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """The same, from findings and their replacements."""
    return with_edits(texts, edits_by_file(findings, mapping))
