import random
import re

from pyspark.sql import functions as F

from veilwright.fixed import PRIORITY
from veilwright.functions.spans import MARK, matches, merged
from veilwright.functions.text import PAGE, with_pages
from veilwright.operators.overlaps import joined_names, resolved
from veilwright.options import FOUND, SPAN

KINDS = list(PRIORITY)


def brute(spans):
    """Each finding against all kept ones; a stronger one puts out all it overlaps, for good."""
    kept = []
    for x in sorted(spans, key=lambda x: (x[1], -PRIORITY[x[0]], x[1] - x[2])):
        hit = [y for y in kept if x[1] < y[2] and y[1] < x[2]]
        rank = lambda y: (PRIORITY[y[0]], y[2] - y[1])
        if not hit:
            kept.append(x)
        elif rank(x) > max(map(rank, hit)):
            kept = [y for y in kept if y not in hit] + [x]
    return sorted(kept, key=lambda x: x[1])


def test_equals_brute_force(spark):
    r = random.Random(5)
    cases = []
    for k in range(1530):
        spans = []
        for _ in range(r.randint(0, 9) if k < 1500 else r.randint(60, 400)):
            a = r.randint(0, 25 if k < 1500 else 900)
            spans.append((r.choice(KINDS), a, a + r.randint(1, 9)))
        cases.append(spans)
    rows = [(k, [(t, a, b, float(j), "s") for j, (t, a, b) in enumerate(spans)]) for k, spans in enumerate(cases)]
    got = spark.createDataFrame(rows, f"k int, found {FOUND}").select("k", resolved(F.col("found")).alias("x")).collect()
    for row in got:
        own = [(x.entity_type, x.start, x.end) for x in row.x]
        assert own == brute(cases[row.k])
        assert all(p[2] <= q[1] for p, q in zip(own, own[1:], strict=False))


def test_equals_keep_the_first(spark):
    rows = [(1, [("NAME", 0, 5, 0.7, "watchlist"), ("NAME", 0, 5, 0.92, "employee_roster")])]
    (r,) = spark.createDataFrame(rows, f"k int, found {FOUND}").select(resolved(F.col("found")).alias("x")).collect()
    assert [x.source for x in r.x] == ["watchlist"]


def test_adjacent_names(spark):
    text = "Mario Rossi,Bianchi\nVerdi  \t Neri\x0bGallo MarioRossi"
    words = [("Mario", 0.7, "a"), ("Rossi", 0.9, "a"), ("Bianchi", 0.7, "a"), ("Verdi", 0.7, "a"), ("Neri", 0.8, "b"), ("Gallo", 0.7, "b")]
    found = [("NAME", text.index(w), text.index(w) + len(w), c, s) for w, c, s in words]
    texts, body = with_pages(spark.createDataFrame([(text, found)], f"text string, found {FOUND}"))
    (r,) = texts.select(joined_names(body, F.col("found")).alias("x")).collect()
    assert [(text[x.start : x.end], x.confidence, x.source) for x in r.x] == [("Mario Rossi", 0.9, "a"), ("Bianchi", 0.7, "a"), ("Verdi  \t Neri\x0bGallo", 0.8, "mixed")]


def test_merged_ranges(spark):
    r = random.Random(6)
    cases = [[(a, a + r.randint(1, 6)) for a in (r.randint(0, 40) for _ in range(r.randint(0, 8)))] for _ in range(300)]
    cases += [[(a, a + r.randint(1, 6)) for a in (r.randint(0, 900) for _ in range(n))] for n in (64, 65, 66, 121, 122, 300)]
    got = spark.createDataFrame(list(enumerate(cases)), f"k int, r {SPAN}").select("k", merged(F.col("r")).alias("m")).collect()
    for row in got:
        want = []
        for a, b in sorted(cases[row.k]):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        assert [[x.start, x.end] for x in row.m] == want


def test_matches_equal_the_pattern(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("ab1 \n€😀" + MARK) for _ in range(n)) for n in (0, 1, 5, 40, 400, 1000)]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for pattern in ("[ab]+", "a1?", "€|😀+", f"{MARK}", "(?s).", "zzz"):
        for row in df.select("text", matches(F.col("text"), pattern).alias("m")).collect():
            want = [m.span() for m in re.finditer(pattern, row.text)]
            if pattern != MARK:  # a stand-in takes the place of the mark
                assert [(x.start, x.end) for x in row.m] == want, (pattern, row.text)
    for row in df.select("text", matches(F.col("text"), "(a)(b+)(1?)", grouped=True).alias("m")).collect():
        assert [(x.start, x.end) for x in row.m] == [m.span(2) for m in re.finditer("(a)(b+)(1?)", row.text)]


def test_pages_equal_the_text(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("ab€😀\n" if k % 2 else "abcdefgh") for _ in range(n)) for k, n in enumerate((0, 10, PAGE, PAGE + 1, 3 * PAGE + 7, 70 * PAGE))]
    texts.append("x\n" + "y" * (2 * PAGE) + "\n" + "z" * 3 * PAGE)
    rows = [(t, a, min(len(t), a + r.choice((0, 1, 30, PAGE, 2 * PAGE)))) for t in texts for a in sorted({0, len(t) // 2, max(0, len(t) - 3), *(r.randrange(len(t) + 1) for _ in range(8)), min(len(t), PAGE), min(len(t), 2 * PAGE)})]
    df, body = with_pages(spark.createDataFrame(rows, "text string, a int, b int"))
    a, b = F.col("a"), F.col("b")
    for x in df.select("text", "a", "b", body.part(a, b).alias("part"), body.line_no(a).alias("line"), body.line_begin(a).alias("begin"), body.line(a, b).alias("around"), body.context(a, b).alias("context")).collect():
        t = x.text
        begin = t.rfind("\n", 0, x.a) + 1
        assert x.part == t[x.a : x.b] and x.line == t.count("\n", 0, x.a) + 1 and x.begin == begin
        assert x.around == t[begin : x.b] + t[x.b :].split("\n", 1)[0]
        assert x.context == t[max(0, x.a - 75) : x.a] + "[[" + t[x.a : x.b] + "]]" + t[x.b : x.b + 75]
