"""One long file: work and results follow its length, not its square."""

import time

from veilwright.operators.replace import apply_map
from veilwright.options import ScanOptions
from veilwright.plans.scan import scan


def source(lines: int) -> str:
    """Lines of a hundred characters; every tenth has an address, every seventh a name and a phone."""
    out = []
    for k in range(lines):
        if k % 10 == 0:
            body = f"       MOVE 'user{k}@example.com' TO WS-MAIL-{k}."
        elif k % 7 == 0:
            body = f"      * CONTATTARE MARIO ROSSI TEL 02{k:08d} PER IL PROGRAMMA"
        else:
            body = f"       COMPUTE WS-TOTAL-{k} = WS-TOTAL-{k} + 1"
        out.append(body.ljust(99))
    return "\n".join(out) + "\n"


def test_a_file_of_ten_megabytes(spark):
    lines = 100_000
    text = source(lines)
    assert len(text) == 10_000_000
    began = time.perf_counter()
    texts = spark.createDataFrame([("big", text)], "file string, text string")
    rows = scan(texts, ScanOptions(names=("Mario", "Rossi"))).collect()
    mails = [r for r in rows if r.entity_type == "EMAIL"]
    phones = [r for r in rows if r.entity_type == "PHONE"]
    names = [r for r in rows if r.entity_type == "NAME"]
    sevenths = [k for k in range(lines) if k % 7 == 0 and k % 10]
    assert len(mails) == lines // 10 and len(phones) == len(names) == len(sevenths)
    for r in mails[:: len(mails) // 50]:
        assert text[r.start : r.end] == r.text == f"user{r.line_no - 1}@example.com" and r.col_no == 14
        assert r.context == text[max(0, r.start - 75) : r.start] + "[[" + r.text + "]]" + text[r.end : r.end + 75]
    assert {(r.line_no - 1) for r in phones} == set(sevenths)
    assert time.perf_counter() - began < 120


def test_many_edits_of_one_file(spark):
    text = source(20_000)
    texts = spark.createDataFrame([("big", text)], "file string, text string")
    found = scan(texts, ScanOptions(entities=frozenset(["EMAIL"])))
    mapping = found.selectExpr("entity_type", "upper(text) AS key", "'x@y.z' AS replacement").distinct()
    (row,) = apply_map(texts, found, mapping).collect()
    assert row.replacements == 2000 and row.text == "\n".join(f"       MOVE 'x@y.z' TO WS-MAIL-{k}." + " " * (99 - len(f"       MOVE 'user{k}@example.com' TO WS-MAIL-{k}.")) if k % 10 == 0 and line else line for k, line in enumerate(text.split("\n")))
