"""Overlap resolution and merging of adjacent names, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.fixed import PRIORITY
from veilwright.functions.spans import runs, runs_sql, worked_out
from veilwright.functions.text import Body
from veilwright.options import FOUND


def resolved(found: Column) -> Column:
    """Disjoint findings by start: of overlapping ones the higher priority, then the longer stays.

    A finding yields to a later one only if that is strictly stronger, and never comes back. Kept
    spans are disjoint and come by start, so a new one can only overlap the last of them.
    Of equals the earlier in the array stays.
    """

    rank = "case y.entity_type " + " ".join(f"when '{name}' then {-value}" for name, value in PRIORITY.items()) + " else 0 end"
    keyed = f"array_sort(transform(own, (y, k) -> struct(y.start as s, {rank} as p, y.start - y.end as l, k as k, y as x)))"

    def combine(last: str, y: str) -> str:
        stronger = f"{y}.p < {last}.p or ({y}.p = {last}.p and {y}.l < {last}.l)"
        return f"if({y}.x.start < {last}.x.end, if({stronger}, {y}, {last}), null)"

    kept = runs_sql("sorted", f"array<struct<s:int,p:int,l:int,k:int,x:{FOUND.removeprefix('array<').removesuffix('>')}>>", combine)
    several = f"get(transform(array({keyed}), sorted -> transform({kept}, y -> y.x)), 0)"
    return worked_out(found, f"own -> if(size(own) > 1, {several}, own)").cast(FOUND)


def joined_names(body: Body, found: Column) -> Column:
    """Names with only blanks between them on one line, as one; ``found`` is disjoint and sorted."""

    def combine(last: Column, x: Column) -> Column:
        gap, way = body.part(last["end"], x["start"]), body.part(last["start"], x["start"])
        near = gap.rlike("(?U)^[\\s\\x1C-\\x1F]+$") & ~way.contains("\n")
        source = F.when(last["source"] == x["source"], x["source"]).otherwise("mixed")
        one = F.struct(x["entity_type"].alias("entity_type"), last["start"].alias("start"), x["end"].alias("end"), F.greatest(last["confidence"], x["confidence"]).alias("confidence"), source.alias("source"))
        return F.when(near, one)

    return runs(found, FOUND, combine)
