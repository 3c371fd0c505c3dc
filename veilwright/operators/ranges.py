"""Where names are looked for: comment lines, lines that speak of people, quoted literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.fixed import NAME_LINE_MARKERS, QUOTED
from veilwright.functions.spans import int_of, matches, merged
from veilwright.functions.text import BLANK, lines_by_newline
from veilwright.options import SPAN

LINE = "[^\\n]*\\n|[^\\n]+"  # of a text whose lines all end by newlines


def comment_line(line: Column) -> Column:
    """A star or ``//*`` first, or a star in column 7 of fixed format."""
    return line.rlike(f"(?sU)^{BLANK}*(?:\\*|//\\*)|^.{{6}}\\*")


def name_line(line: Column) -> Column:
    return comment_line(line) | F.upper(line).rlike("|".join(NAME_LINE_MARKERS))


def lines(text: Column) -> Column:
    return matches(lines_by_newline(text), LINE)


def name_ranges(text: Column, scope: str, comments_only: bool = False) -> Column:
    """Merged ranges in which names count; in scope ``all`` the whole text."""
    if scope == "all":
        return F.array(F.struct(F.lit(0).alias("start"), int_of(F.length(text)).alias("end"))).cast(SPAN)
    rule = comment_line if comments_only else name_line
    chosen = matches(lines_by_newline(text), LINE, keep=rule)
    return merged(F.concat(chosen, matches(text, QUOTED)))
