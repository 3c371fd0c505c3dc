"""Decoding, positions, contexts and value keys as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.fixed import CONTEXT_RADIUS, NON_LINKABLE
from veilwright.functions.spans import fold

BREAKS = "\\n\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029"  # what ends a line, once newlines are normalized
BLANK = "[\\s\\x1C-\\x1F]"
_BITS = 12
PAGE = 1 << _BITS
_ODD_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, else the whole file as Latin-1; every newline becomes LF."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\\r\\n?", "\n")


def lines_by_newline(text: Column) -> Column:
    """The text with a newline for each character of ``BREAKS``: the same offsets, and a pattern of lines needs one plain class."""
    odd = reduce(or_, (text.contains(x) for x in _ODD_BREAKS))
    return F.when(odd, F.translate(text, _ODD_BREAKS, "\n" * len(_ODD_BREAKS))).otherwise(text)


def part(text: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` .. ``end`` (0-based, half open)."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


@dataclass(frozen=True)
class Body:
    """A text in pages of ``PAGE`` characters, so that reading a span costs a page and not all that comes before it.

    ``pages``: a column with an array of (page, lines: newlines before the page, begin: where the line begun last begins).
    """

    text: Column
    pages: Column

    def part(self, start: Column, end: Column) -> Column:
        low, high = F.shiftright(start, _BITS), F.shiftright(F.greatest(end - 1, start), _BITS)
        own = F.when(low == high, self._page(low)).otherwise(F.array_join(F.transform(F.slice(self.pages, low + 1, high - low + 1), lambda p: p["page"]), ""))
        return part(own, start - F.shiftleft(low, _BITS), end - F.shiftleft(low, _BITS))

    def _page(self, k: Column) -> Column:
        return F.coalesce(F.get(self.pages, k)["page"], F.lit(""))

    def _before(self, start: Column) -> tuple[Column, Column]:
        """The page with ``start`` and what of it comes before."""
        k = F.shiftright(start, _BITS)
        return F.get(self.pages, k), part(self._page(k), F.lit(0), start - F.shiftleft(k, _BITS))

    def line_no(self, start: Column) -> Column:
        page, left = self._before(start)
        return (F.coalesce(page["lines"], F.lit(0)) + F.length(left) - F.length(F.replace(left, F.lit("\n"), F.lit(""))) + 1).cast("int")

    def line_begin(self, start: Column) -> Column:
        """Where the line (by LF) with ``start`` begins."""
        page, left = self._before(start)
        return F.when(left.contains("\n"), start - F.length(F.substring_index(left, "\n", -1))).otherwise(F.coalesce(page["begin"], F.lit(0))).cast("int")

    def context(self, start: Column, end: Column, radius: int = CONTEXT_RADIUS) -> Column:
        low = F.greatest(start - radius, F.lit(0))
        return F.concat(self.part(low, start), F.lit("[["), self.part(start, end), F.lit("]]"), self.part(end, end + radius))

    def rest_of_line(self, end: Column, reach: int = 512) -> Column:
        """From ``end`` to the line's end, without its LF."""
        near = self.part(end, end + reach)
        return F.when(near.contains("\n") | (F.length(near) < reach), F.substring_index(near, "\n", 1)).otherwise(F.substring_index(F.substring(self.text, end + 1, F.length(self.text)), "\n", 1))

    def line(self, start: Column, end: Column) -> Column:
        """The line (by LF) around a span."""
        return F.concat(self.part(self.line_begin(start), end), self.rest_of_line(end))


def with_pages(texts: DataFrame, column: str = "pages") -> tuple[DataFrame, Body]:
    """``texts`` (text) with its pages; texts of one page are the usual case."""
    kind = "array<struct<page:string,lines:int,begin:int>>"
    cut = F.regexp_extract_all(F.col("text"), F.lit("(?s).{1,%d}" % PAGE), F.lit(0))

    def step(acc: Column, page: Column) -> Column:
        here = F.struct(page.alias("page"), acc["state"]["lines"].alias("lines"), acc["state"]["begin"].alias("begin"))
        begin = F.when(page.contains("\n"), acc["state"]["at"] + F.length(page) - F.length(F.substring_index(page, "\n", -1))).otherwise(acc["state"]["begin"])
        lines = acc["state"]["lines"] + F.length(page) - F.length(F.replace(page, F.lit("\n"), F.lit("")))
        state = F.struct((acc["state"]["at"] + F.length(page)).alias("at"), lines.alias("lines"), begin.alias("begin"))
        return F.struct(state.alias("state"), F.array_append(acc["out"], here).alias("out"))

    one = F.array(F.struct(F.col("text").alias("page"), F.lit(0).alias("lines"), F.lit(0).alias("begin"))).cast(kind)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("lines"), F.lit(0).alias("begin"))
    pages = F.when(F.length("text") <= PAGE, one).otherwise(fold(cut, zero, kind, step))
    return texts.withColumn(column, pages), Body(F.col("text"), F.col(column))


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, f"(?U)^{BLANK}+|{BLANK}+$", "")


def collapsed(value: Column) -> Column:
    return F.regexp_replace(stripped(value), f"(?U){BLANK}+", " ")


def normalized(value: Column) -> Column:
    return F.upper(collapsed(value))


def finding_key(entity: Column, value: Column, file: Column, line: Column, col: Column) -> Column:
    """The value; for entities that must not be linked, the place and the value."""
    own = F.concat_ws(":", F.lit("OCCURRENCE"), file, line.cast("string"), col.cast("string"), normalized(value))
    return F.when(entity.isin(*NON_LINKABLE), own).otherwise(normalized(value))
