"""The detectors over texts of ASCII alone, in Python: one pass a text, several times faster than the column expressions.

In ASCII the patterns mean the same to both engines (words, digits, blanks and case folds have no other members), so findings
are equal; texts with other characters, and options that :func:`covers` leaves out, are left to the expressions of
:mod:`veilwright.operators.detectors`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from veilwright.fixed import ADDRESS_STOPS, CODICE_FISCALE, CONTEXT_RADIUS, EMAIL, IBAN, NAME_LINE_MARKERS, PRIORITY, QUOTED
from veilwright.operators import detectors
from veilwright.options import FINDING, ScanOptions

Found = tuple[str, int, int, float, str]
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_STOPS = frozenset(_BLANKS + ADDRESS_STOPS)
_ODD = re.compile("[\x0b\x0c\x1c-\x1e]")
_COMMENT = re.compile(r"[\s\x1c-\x1f]*(?:\*|//\*)|.{6}\*", re.A | re.S)
_MARKERS = re.compile("|".join(map(re.escape, NAME_LINE_MARKERS)))
_QUOTED = re.compile(QUOTED)
_WHOLE = 64  # entries of a list that are one pattern for all texts; from longer lists a text's own are taken
_ROWS = 500
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _pattern(text: str) -> re.Pattern:
    return re.compile(text.removeprefix(detectors.FOLD), re.A | re.I)


_EMAIL, _IBAN, _TAX_CODE, _PHONE, _STAFF = (_pattern(p) for p in (EMAIL, IBAN, CODICE_FISCALE, detectors.PHONE_LABELLED, detectors.STAFF_NUMBER))
_LABELLED = tuple(map(_pattern, detectors.STAFF_LABELLED))


def covers(options: ScanOptions) -> bool:
    """Whether texts can be scanned here: names of a recognizer, unknown names and lists beyond ASCII are left to expressions."""
    if "NAME" not in options.entities:
        return True
    return options.recognizer is None and not options.unknown_names and all(n.isascii() for n in (*options.names, *options.roster_names))


def _list(names: tuple[str, ...], least: int) -> Callable[[set[str]], re.Pattern | None] | None:
    """From the words of a text to the pattern of the entries that can occur in it."""
    entries = [(detectors.head(n), detectors.name_pattern(n, least)) for n in detectors.listed(names, least)]
    if not entries:
        return None
    heads, always = {h for h, _ in entries if h}, any(not h for h, _ in entries)

    @lru_cache(maxsize=256)
    def of(present: frozenset[str]) -> re.Pattern:
        chosen = [p for h, p in entries if len(entries) <= _WHOLE or not h or h in present]
        return re.compile(rf"(?<![\w\-])(?:{'|'.join(chosen)})(?![\w\-])", re.A | re.I)

    everything = frozenset(heads)

    def pattern(words: set[str]) -> re.Pattern | None:
        present = heads & words
        return of(everything if len(entries) <= _WHOLE else frozenset(present)) if present or always else None

    return pattern


def _ranges(text: str) -> list[list[int]]:
    own, start, size = _ODD.sub("\n", text), 0, len(text)
    upper, spans = own.upper(), []
    while start < size:
        end = own.find("\n", start) + 1 or size
        if _COMMENT.match(own[start:end]) or _MARKERS.search(upper, start, end):
            spans.append((start, end))
        start = end
    spans += [m.span() for m in _QUOTED.finditer(text)]
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _in_address(text: str, start: int, end: int) -> bool:
    low, last = 0, start
    if start and text[start - 1] == "\r":  # a carriage return before a name ends the line there, but not the token
        low, last = max(start - detectors._REACH, 0), start - 1
    a, b, size = last, end, len(text)
    while a > low and text[a - 1] not in _STOPS:
        a -= 1
    while b < size and text[b] not in _STOPS:
        b += 1
    token = text[a:last] + text[start:b]
    return "@" in token or "://" in token


def _resolved(found: list[Found]) -> list[Found]:
    if len(found) < 2:
        return found
    out: list[Found] = []
    for y in sorted(found, key=lambda x: (x[1], -PRIORITY[x[0]], x[1] - x[2])):
        if out and y[1] < out[-1][2]:
            last = out[-1]
            if (-PRIORITY[y[0]], y[1] - y[2]) < (-PRIORITY[last[0]], last[1] - last[2]):
                out[-1] = y
        else:
            out.append(y)
    return out


def _named(text: str, pattern: re.Pattern, ranges: list[list[int]], source: str, sure: float) -> list[Found]:
    out: list[Found] = []
    for a, b in ranges:
        for m in pattern.finditer(text[a:b]):
            start, end = a + m.start(), a + m.end()
            if _in_address(text, start, end):
                continue
            if out:
                begin, last = out[-1][1:3]
                if start > last and not text[last:start].strip(_BLANKS) and "\n" not in text[begin:start]:
                    out[-1] = ("NAME", begin, end, sure, source)
                    continue
            out.append(("NAME", start, end, sure, source))
    return out


def scanner(options: ScanOptions) -> Callable[[str], list[Found]]:
    """From a text to its findings, disjoint and by start."""
    want = options.entities
    rules = [("EMAIL", _EMAIL, 0, 0.98, "regex")] if "EMAIL" in want else []
    rules += [("IBAN", _IBAN, 0, 0.96, "regex")] if "IBAN" in want else []
    rules += [("CODICE_FISCALE", _TAX_CODE, 0, 0.96, "regex")] if "CODICE_FISCALE" in want else []
    if want & {"MATRICOLA", "SUSPECTED_MATRICOLA"}:
        lone = [("SUSPECTED_MATRICOLA", _STAFF, 0, 0.68, "not_in_employee_roster")]
        rules += lone if options.roster is not None else [("MATRICOLA", p, 2, 0.84, "regex") for p in _LABELLED]
    rules += [("PHONE", _PHONE, 2, 0.78, "regex")] if "PHONE" in want else []
    lists = [(_list(n, least), source, sure) for n, least, source, sure in ((options.names, 3, "watchlist", 0.70), (options.roster_names, 2, "employee_roster", 0.92))] if "NAME" in want else []
    lists = [x for x in lists if x[0]]
    words = re.compile(r"[\w-]+", re.A)

    def names(text: str) -> list[Found]:
        have = set(words.findall(text.upper()))
        own = [(p, source, sure) for of, source, sure in lists if (p := of(have))]
        ranges = ([[0, len(text)]] if options.scope == "all" else _ranges(text)) if own else []
        return _resolved([x for p, source, sure in own for x in _named(text, p, ranges, source, sure)])

    def scan(text: str) -> list[Found]:
        found = [(kind, *m.span(group), sure, source) for kind, p, group, sure, source in rules if kind != "EMAIL" or "@" in text for m in p.finditer(text)]
        return _resolved(found + names(text) if lists else found)

    return scan


def _rows(text: str, found: list[Found], fields: list[str]) -> Iterator[tuple]:
    at, line, begin = 0, 1, 0
    placed, context = "line_no" in fields or "col_no" in fields, "context" in fields
    for kind, start, end, sure, source in found:
        value = text[start:end]
        if placed:
            if more := text.count("\n", at, start):
                line, begin = line + more, text.rfind("\n", at, start) + 1
            at = start
        own = {
            "entity_type": kind, "text": value.strip(_BLANKS) if source == "regex" else value, "start": start, "end": end, "line_no": line, "col_no": start - begin + 1,
            "confidence": sure, "context": f"{text[max(start - CONTEXT_RADIUS, 0) : start]}[[{value}]]{text[end : end + CONTEXT_RADIUS]}" if context else None, "source": source,
        }
        yield tuple(own[c] for c in fields)


def with_done(texts: DataFrame, options: ScanOptions, fields: list[str]) -> DataFrame:
    """file, text, done, own: of texts of ASCII the findings' ``fields``, ``text`` empty then; others pass as they are."""
    types = [FINDING[c].dataType.simpleString() for c in fields]
    struct = pa.struct([(c, _KINDS[t]) for c, t in zip(fields, types, strict=True)])
    # a roster is a table: only whether there is one counts here
    plain = ScanOptions(options.entities, options.names, options.roster_names, None if options.roster is None else True, options.scope)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(plain)
        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(k, _ROWS)
                left, done, ends, rows = [], [], [0], []
                for text in batch.column(1).to_pylist():
                    own = text is not None and text.isascii()
                    if own:
                        rows += _rows(text, scan(text), fields)
                    left.append("" if own else text)
                    done.append(own)
                    ends.append(len(rows))
                columns = list(zip(*rows, strict=True)) or [()] * len(fields)
                values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, struct, strict=True)], fields=list(struct))
                own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string()), pa.array(done), own], ["file", "text", "done", "own"])

    kind = ",".join(f"{c}:{t}" for c, t in zip(fields, types, strict=True))
    return texts.select("file", "text").mapInArrow(work, f"file {texts.schema['file'].dataType.simpleString()}, text string, done boolean, own array<struct<{kind}>>")
