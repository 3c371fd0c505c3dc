"""Detectors: from a text column to an array of findings on the same row.

Every detector is an expression, so a scan has no shuffle and no text leaves its row. A cheap test comes
before each pattern. The patterns use Unicode classes and case folding (``(?iU)``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.fixed import (
    ADDRESS_STOPS,
    CODICE_FISCALE,
    COMMON_ENDINGS,
    EMAIL,
    IBAN,
    MATRICOLA_LABELS,
    MATRICOLA_VALUE,
    NAME_CONTEXT_WORDS,
    NAME_EDGES,
    NAME_STOPWORDS,
    PHONE_LABELS,
    PHONE_VALUE,
    TECHNICAL_WORDS,
    UNKNOWN_NAME_PREFIXES,
    UNKNOWN_NAME_STOPWORDS,
    UPPER_NAME_TOKEN,
)
from veilwright.functions.spans import inside, int_of, let, matches
from veilwright.functions.text import Body
from veilwright.operators.overlaps import joined_names, resolved
from veilwright.operators.ranges import comment_line, name_ranges
from veilwright.options import FOUND, SPAN, ScanOptions

FOLD = "(?iU)"
STAFF_NUMBER = f"{FOLD}(?<![A-Z0-9]){MATRICOLA_VALUE}(?![A-Z0-9])"
_LABEL = "|".join(map(re.escape, MATRICOLA_LABELS))
_FIELD, _QUOTE, _STAFF = f"[\\w-]*(?:{_LABEL})[\\w-]*\\b", "['\"]?", f"({MATRICOLA_VALUE})(?![A-Z0-9])"
#: Moved to a field, the value of a field, or after a label: ``(before)(number)(after)``.
STAFF_LABELLED = (
    f"{FOLD}(\\bMOVE\\s+{_QUOTE}){_STAFF}({_QUOTE}\\s+TO\\s+{_FIELD})",
    f"{FOLD}(\\b{_FIELD}[^\\r\\n]{{0,90}}\\bVALUE\\s+{_QUOTE}){_STAFF}({_QUOTE})",
    f"{FOLD}(\\b(?:{_LABEL})\\b\\s*[:=]\\s*{_QUOTE}){_STAFF}({_QUOTE})",
)
PHONE_LABELLED = f"{FOLD}(\\b(?:{'|'.join(PHONE_LABELS)})\\b\\s*[:=]?\\s*)({PHONE_VALUE})()"
_REACH = 256  # characters around a span that are looked at first for its token
WORD = "(?U)[\\w-]+"


def findings(spans: Column, entity: str, confidence: float, source: str = "regex") -> Column:
    return F.call_function("transform", spans, F.expr(f"s -> struct('{entity}' as entity_type, s.start as start, s.end as end, {confidence}D as confidence, '{source}' as source)")).cast(FOUND)


def none() -> Column:
    return F.array().cast(FOUND)


def emails(text: Column) -> Column:
    return F.when(text.contains("@"), findings(matches(text, FOLD + EMAIL), "EMAIL", 0.98)).otherwise(none())


def ibans(text: Column) -> Column:
    return findings(matches(text, FOLD + IBAN), "IBAN", 0.96)


def tax_codes(text: Column) -> Column:
    return findings(matches(text, FOLD + CODICE_FISCALE), "CODICE_FISCALE", 0.96)


def phones(text: Column) -> Column:
    return findings(matches(text, PHONE_LABELLED, grouped=True), "PHONE", 0.78)


def labelled_staff_numbers(text: Column) -> Column:
    return F.concat(*(findings(matches(text, p, grouped=True), "MATRICOLA", 0.84) for p in STAFF_LABELLED))


def lone_staff_numbers(text: Column) -> Column:
    """Every staff number that stands alone, as suspected; :func:`classified` tells those that a roster has.

    Both kinds win and lose against the same entities, and two numbers never overlap, so overlaps can be resolved before.
    """
    return findings(matches(text, STAFF_NUMBER), "SUSPECTED_MATRICOLA", 0.68, "not_in_employee_roster")


def classified(found: DataFrame, roster: DataFrame) -> DataFrame:
    """Findings with suspected staff numbers that the roster (matricula) has made known ones.

    Only numbers are joined, on narrow rows; Spark broadcasts the roster where it is measured small and splits hot numbers otherwise.
    """
    known = roster.select(F.col("matricula").alias("known")).distinct()
    suspected = F.col("entity_type") == "SUSPECTED_MATRICOLA"
    judged = found.withColumn("number", F.when(suspected, F.col("text"))).join(known, F.col("number") == F.col("known"), "left")
    has = F.col("known").isNotNull()
    pick = lambda name, value: F.when(has, F.lit(value)).otherwise(F.col(name)).alias(name)
    new = {"entity_type": "MATRICOLA", "confidence": 0.99, "source": "employee_roster"}
    return judged.select(*(pick(c, new[c]) if c in new else F.col(c) for c in found.columns))


def in_address(body: Body, start: Column, end: Column) -> Column:
    """Whether the token around a span is an e-mail address or a URL.

    The text near the span is looked at first; only a token that goes on beyond it makes the whole text be read.
    """
    stop = "\\s\\x1C-\\x1F" + ADDRESS_STOPS
    left = lambda t: F.regexp_extract(F.substring_index(t, "\n", -1), f"(?U)[^{stop}]*$", 0)
    right = lambda t: F.regexp_extract(F.substring_index(t, "\n", 1), f"(?U)^[^{stop}]*", 0)
    marks = lambda t: t.contains("@") | t.contains("://")
    low = F.greatest(start - _REACH, F.lit(0))

    def judged(t: Column) -> Column:
        token = F.concat(
            F.when((F.length(t["left"]) < start - low) | (low == 0), t["left"]).otherwise(left(F.substring(body.text, F.lit(1), start))),
            body.part(start, end),
            F.when(F.length(t["right"]) < _REACH, t["right"]).otherwise(right(F.substring(body.text, end + 1, F.length(body.text)))),
        )
        return let(token, marks)

    def near(t: Column) -> Column:
        # a token does not leave its line, so a line near the span that holds no mark and ends there decides
        before, after = F.substring_index(t["before"], "\n", -1), F.substring_index(t["after"], "\n", 1)
        ends = ((F.length(before) < start - low) | (low == 0)) & (F.length(after) < _REACH)
        none = ends & ~marks(F.concat(before, body.part(start, end), after))
        return F.when(none, F.lit(False)).otherwise(let(F.struct(left(t["before"]).alias("left"), right(t["after"]).alias("right")), judged))

    return let(F.struct(body.part(low, start).alias("before"), body.part(end, end + _REACH).alias("after")), near)


def name_pattern(name: str, least: int) -> str | None:
    """One entry as a pattern: blanks stretch, one-letter words may carry a dot."""
    words = name.split()
    if not words or len(words) == 1 and len(words[0]) < least:
        return None
    quoted = [re.sub(r"([^\w\s])", r"\\\1", w) for w in words]
    if len(words) > 1:
        quoted = [q + "\\.?" if len(w) == 1 else q for q, w in zip(quoted, words, strict=True)]
    return "\\s+".join(quoted)


def listed(names: Iterable[str], least: int) -> list[str]:
    """The entries that are looked for, longest first."""
    return sorted({n for n in names if name_pattern(n, least)}, key=lambda n: (-len(n), n.upper()))


def head(name: str) -> str:
    """The word that a text must have for an entry to occur."""
    return m[0].upper() if (m := re.search(r"[\w-]+", name)) else ""


def with_pattern(texts: DataFrame, column: str, names: Iterable[str], least: int = 3) -> DataFrame:
    """With ``column``: a pattern of just the entries that can occur in ``text``, longest first; null if there are none.

    The words of the text are looked up in the list by hash, so most texts are never searched. The words
    found are a column of their own: inside the filter below they would be worked out for each entry.
    """
    entries = listed(names, least)
    if not entries:
        return texts.withColumn(column, F.lit(None).cast("string"))
    first = {n: head(n) for n in entries}
    table = F.from_json(F.lit(json.dumps([{"head": first[n], "pattern": name_pattern(n, least)} for n in entries])), "array<struct<head:string,pattern:string>>")
    heads = sorted({x for x in first.values() if x})
    present = F.array_distinct(F.filter(F.regexp_extract_all(F.upper("text"), F.lit(WORD), F.lit(0)), lambda w: w.isin(heads)))
    if "" in first.values():
        present = F.array_append(present, F.lit(""))
    here = F.transform(F.filter(table, lambda e: F.array_contains(F.col(column + "_heads"), e["head"])), lambda e: e["pattern"])
    some = F.when(F.size(column + "_heads") > 0, F.array_join(here, "|"))
    return texts.withColumn(column + "_heads", present).withColumn(column, F.concat(F.lit("(?iU)(?<![\\w\\-])(?:"), some, F.lit(")(?![\\w\\-])")))


def in_ranges(body: Body, pattern: Column | str, ranges: Column) -> Column:
    """Spans of matches inside ranges."""

    def search(r: Column) -> Column:
        return F.transform(matches(body.part(r["start"], r["end"]), pattern), lambda s: F.struct(int_of(r["start"] + s["start"]).alias("start"), int_of(r["start"] + s["end"]).alias("end")))

    return F.flatten(F.transform(ranges, search)).cast(SPAN)


def watchlist(body: Body, pattern: Column, ranges: Column, source: str = "watchlist", confidence: float = 0.70) -> Column:
    """Names of a list inside ranges; ``pattern`` is that of :func:`with_pattern`."""
    spans = F.filter(in_ranges(body, pattern, ranges), lambda s: ~in_address(body, s["start"], s["end"]))
    found = joined_names(body, resolved(findings(spans, "NAME", confidence, source)))
    return F.when(pattern.isNotNull(), found).otherwise(none())


def _person_word(line: Column) -> Column:
    return F.upper(line).rlike("|".join(map(re.escape, NAME_CONTEXT_WORDS)))


def isolated_surname(value: Column) -> Column:
    letters = F.upper(F.replace(value, F.lit("'"), F.lit("")))
    return F.length(letters).between(4, 18) & ~letters.isin(*NAME_STOPWORDS, *UNKNOWN_NAME_STOPWORDS) & ~letters.rlike(f"({'|'.join(COMMON_ENDINGS)})$")


def unknown_names(body: Body, ranges: Column, least: int = 4) -> Column:
    """Upper-case words in comments and literals that look like surnames, for review. A word's value and line are read once."""
    stop = [*NAME_STOPWORDS, *UNKNOWN_NAME_STOPWORDS, *NAME_CONTEXT_WORDS]

    def trim(s: Column) -> Column:
        def edges(value: Column) -> Column:
            left = F.length(value) - F.length(F.ltrim(value, F.lit(NAME_EDGES)))
            bare = F.trim(value, F.lit(NAME_EDGES))
            return F.struct(int_of(s["start"] + left).alias("start"), int_of(s["start"] + left + F.length(bare)).alias("end"), F.translate(bare, "’", "'").alias("value"))

        return let(body.part(s["start"], s["end"]), edges)

    def shaped(w: Column) -> Column:
        return (w["start"] < w["end"]) & (F.length(F.replace(w["value"], F.lit("'"), F.lit(""))) >= least) & ~F.upper(w["value"]).isin(stop) & ~F.upper(w["value"]).rlike(f"^({'|'.join(UNKNOWN_NAME_PREFIXES)})")

    def judged(w: Column) -> Column:
        def sure(line: Column) -> Column:
            return F.when(w["value"].contains("'"), 0.72).when(_person_word(line), 0.68).when(comment_line(line) & isolated_surname(w["value"]), 0.58)

        return F.struct(F.lit("NAME").alias("entity_type"), w["start"].alias("start"), w["end"].alias("end"), let(body.line(w["start"], w["end"]), sure).alias("confidence"), F.lit("unknown_name_heuristic").alias("source"))

    words = F.filter(F.transform(in_ranges(body, "(?U)" + UPPER_NAME_TOKEN, ranges), trim), shaped)
    told = F.filter(F.transform(words, judged), lambda x: x["confidence"].isNotNull())
    return resolved(F.filter(told, lambda x: ~in_address(body, x["start"], x["end"])).cast(FOUND))


def recognized_names(body: Body, raw: Column, ranges: Column) -> Column:
    """Names from an entity recognizer (``raw``: start, end, score), trimmed and cleared of false positives."""
    edge = "|".join(NAME_STOPWORDS)
    blank = "[\\s\\x1C-\\x1F]"

    def trim(s: Column) -> Column:
        value = body.part(s["start"], s["end"])
        lead = F.length(F.regexp_extract(value, f"(?iU)^({blank}*([:,.;]*({edge})[:,.;]*(?={blank}|$){blank}*)*)", 0))
        rest = F.substring(value, lead + 1, F.length(value))
        tail = F.length(F.regexp_extract(rest, f"(?iU)(((?<={blank})|^)[:,.;]*({edge})[:,.;]*{blank}*)+$", 0))
        bare = F.regexp_replace(F.substring(rest, F.lit(1), F.length(rest) - tail), f"(?U){blank}+$", "")
        return F.struct(int_of(s["start"] + lead).alias("start"), int_of(s["start"] + lead + F.length(bare)).alias("end"), s["score"].alias("score"))

    def real(s: Column) -> Column:
        value = body.part(s["start"], s["end"])
        words = F.split(F.upper(F.regexp_replace(F.trim(value), f"(?U){blank}+", " ")), " ")
        single = (F.size(words) == 1) & (value == F.upper(value)) & (value != F.lower(value))
        odd = value.rlike("(?U)[\\d='\"\\-]") | single | F.arrays_overlap(words, F.array(*map(F.lit, TECHNICAL_WORDS + NAME_STOPWORDS)))
        return (s["start"] < s["end"]) & inside(s["start"], s["end"], ranges) & ~in_address(body, s["start"], s["end"]) & ~odd

    kept = F.filter(F.transform(raw, trim), real)
    return F.transform(kept, lambda s: F.struct(F.lit("NAME").alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].cast("double").alias("confidence"), F.lit("presidio_spacy").alias("source"))).cast(FOUND)


def with_findings(texts: DataFrame, body: Body, options: ScanOptions, recognized: str | None = None) -> DataFrame:
    """With ``found``: findings of the selected detectors in ``text``; names are resolved among themselves first, then all.

    What several detectors share (ranges, patterns) are columns of their own, worked out once a row.
    """
    text, want, out = body.text, options.entities, []
    if "NAME" in want:
        lists = [x for x in (("listed", options.names, 3, "watchlist", 0.70), ("known", options.roster_names, 2, "employee_roster", 0.92)) if x[1]]
        some = F.lit(recognized is not None)  # ranges are worked out where a name can occur
        for column, entries, least, _, _ in lists:
            texts = with_pattern(texts, column, entries, least)
            some = some | F.col(column).isNotNull()
        texts = texts.withColumn("ranges", F.when(some, name_ranges(text, options.scope)).otherwise(F.array().cast(SPAN)))
        names = [recognized_names(body, F.col(recognized), F.col("ranges"))] if recognized else []
        names += [watchlist(body, F.col(column), F.col("ranges"), source, sure) for column, _, _, source, sure in lists]
        if options.unknown_names:
            texts = texts.withColumn("comments", name_ranges(text, options.scope, comments_only=True))
            names.append(unknown_names(body, F.col("comments"), options.unknown_min_length))
        settled = len(names) == 1 and not recognized  # names of one list are disjoint already
        texts = texts.withColumn("names", names[0] if settled else resolved(F.concat(*names)) if names else none())
    if "EMAIL" in want:
        out.append(emails(text))
    if "IBAN" in want:
        out.append(ibans(text))
    if "CODICE_FISCALE" in want:
        out.append(tax_codes(text))
    if want & {"MATRICOLA", "SUSPECTED_MATRICOLA"}:
        out.append(lone_staff_numbers(text) if options.roster is not None else labelled_staff_numbers(text))
    if "PHONE" in want:
        out.append(phones(text))
    if "NAME" in want:
        out.append(F.col("names"))
    return texts.withColumn("raw", F.concat(*out) if out else none()).withColumn("found", resolved(F.col("raw")))
