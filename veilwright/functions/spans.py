"""Regular-expression matches with their offsets, and folds over sorted spans, row by row.

Arrays are immutable, so a fold that appends to one copies it at each step. :func:`fold` works in blocks of the square
root of the length: a file with a hundred thousand matches costs a few hundred copies an element, not fifty thousand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.options import SPAN

#: Two code points that no text holds (Unicode sets them aside): one marks the edges of matches, the other stands for it in a text that has it.
MARK, STAND_IN = "\uFDD0", "\uFDD1"
SHORT = 64


def int_of(c: Column) -> Column:
    return c.cast("int")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sql_text(value: str) -> str:
    """A string as a literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def worked_out(value: Column, rule: str) -> Column:
    """What the SQL lambda ``rule`` (such as ``x -> x + 1``) makes of a value: one call, however large the expression."""
    return F.get(F.call_function("transform", F.array(value), F.expr(rule)), F.lit(0))


def fold_sql(items: str, state: str, kind: str, more: Callable[[str, str], str], last: Callable[[str], str]) -> str:
    """:func:`fold` as SQL text: ``more(acc, x)`` is the new struct of ``state`` and ``out``; ``items`` is a name."""
    none, width = f"cast(array() as {kind})", f"cast(ceil(sqrt(size({items}))) as int)"
    inner = lambda own, begin: f"aggregate({own}, struct({begin} as state, {none} as out), (acc, x) -> {more('acc', 'x')}"
    blocks = f"transform(sequence(0, cast(ceil(size({items}) / {width}) as int) - 1), b -> slice({items}, b * {width} + 1, {width}))"
    each = f"(all, block) -> get(transform(array({inner('block', 'all.state')})), r -> struct(r.state as state, array_append(all.outs, r.out) as outs)), 0)"
    large = f"aggregate({blocks}, struct({state} as state, cast(array() as array<{kind}>) as outs), {each}, all -> concat(flatten(all.outs), {last('all.state')}))"
    return f"if(size({items}) <= {SHORT}, {inner(items, state)}, acc -> concat(acc.out, {last('acc.state')})), {large})"


def fold(items: Column, state: Column, kind: str, step: Callable[[Column, Column], Column], last: Callable[[Column], Column] | None = None) -> Column:
    """What ``step(acc, item)`` gathers: ``acc`` is a struct of ``state`` and ``out``, an array of type ``kind``.

    ``last`` turns the final state into an array of what is still to be added.
    """
    empty = F.array().cast(kind)

    def whole(own: Column, begin: Column) -> Column:
        return F.aggregate(own, F.struct(begin.alias("state"), empty.alias("out")), step)

    def end(acc: Column, out: Column) -> Column:
        return F.concat(out, last(acc["state"])) if last else out

    def in_blocks(own: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(own))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(own) / width).cast("int") - 1), lambda b: F.slice(own, b * width + 1, width))
        start = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("outs"))
        each = lambda acc, block: let(whole(block, acc["state"]), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["outs"], r["out"]).alias("outs")))
        return F.aggregate(blocks, start, each, lambda acc: end(acc, F.flatten(acc["outs"])))

    return let(items, lambda own: F.when(F.size(own) <= SHORT, F.aggregate(own, F.struct(state.alias("state"), empty.alias("out")), step, lambda acc: end(acc, acc["out"]))).otherwise(in_blocks(own)))


def runs(items: Column, kind: str, combine: Callable[[Column, Column], Column]) -> Column:
    """Sorted ``items``, each folded into the one before where ``combine(last, item)`` is not null."""
    element = kind.removeprefix("array<").removesuffix(">")

    def step(acc: Column, x: Column) -> Column:
        more = F.struct(x.alias("state"), F.array_append(acc["out"], acc["state"]).alias("out"))
        joined = lambda c: F.when(c.isNull(), more).otherwise(F.struct(c.alias("state"), acc["out"].alias("out")))
        return F.when(acc["state"].isNull(), F.struct(x.alias("state"), acc["out"].alias("out"))).otherwise(let(combine(acc["state"], x), joined))

    return fold(items, F.lit(None).cast(element), kind, step, lambda s: F.when(s.isNull(), F.array().cast(kind)).otherwise(F.array(s)))


def runs_sql(items: str, kind: str, combine: Callable[[str, str], str]) -> str:
    """:func:`runs` as SQL text."""
    element = kind.removeprefix("array<").removesuffix(">")
    joined = f"if(c is null, struct(x as state, array_append(acc.out, acc.state) as out), struct(c as state, acc.out as out))"
    more = lambda acc, x: f"if({acc}.state is null, struct({x} as state, {acc}.out as out), get(transform(array({combine(f'{acc}.state', x)}), c -> {joined}), 0))"
    return fold_sql(items, f"cast(null as {element})", kind, more, lambda s: f"if({s} is null, cast(array() as {kind}), array({s}))")


def _running(items: str) -> str:
    """Sums up to and with each number, as SQL text."""
    return fold_sql(items, "0", "array<int>", lambda acc, x: f"struct({acc}.state + {x} as state, array_append({acc}.out, {acc}.state + {x}) as out)", lambda s: "cast(array() as array<int>)")


def matches(text: Column, pattern: Column | str, grouped: bool = False, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of all matches. ``grouped``: the pattern is ``(before)(value)(after)``, the span that of the value.

    One pass: a replacement puts a mark at both edges of each match, and the lengths of the pieces between marks give the
    offsets. ``keep`` judges the matched strings.
    """
    own = "x.p" if isinstance(pattern, Column) else sql_text(pattern)
    value = F.struct(text.alias("t"), pattern.alias("p")) if isinstance(pattern, Column) else F.struct(text.alias("t"))
    edges = sql_text(f"$1{MARK}$2{MARK}$3" if grouped else f"{MARK}$0{MARK}")
    clean = f"if(contains(x.t, '{MARK}'), translate(x.t, '{MARK}', '{STAND_IN}'), x.t)"
    span = "struct(get(e, k - 1) as start, get(e, k) as end" + (", get(p, k) as text)" if keep else ")")
    kind = "array<struct<start:int,end:int,text:string>>" if keep else SPAN
    spans = f"get(transform(array(transform(p, y -> length(y))), n -> get(transform(array({_running('n')}), e -> transform(sequence(1, size(p) - 2, 2), k -> {span})), 0)), 0)"
    found = worked_out(value, f"x -> get(transform(array(split(regexp_replace({clean}, {own}, {edges}), '{MARK}', -1)), p -> if(size(p) > 1, {spans}, cast(array() as {kind}))), 0)")
    return F.transform(F.filter(found, lambda s: keep(s["text"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) if keep else found


def merged(ranges: Column) -> Column:
    """The union of ranges; those that touch become one."""
    joined = lambda last, x: f"if({x}.start <= {last}.end, struct({last}.start as start, greatest({last}.end, {x}.end) as end), null)"
    return worked_out(F.array_sort(ranges), f"own -> {runs_sql('own', SPAN, joined)}")


def inside(start: Column, end: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (start >= r["start"]) & (end <= r["end"]))
