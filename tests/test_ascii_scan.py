"""Texts of ASCII are scanned in Python: findings equal those of the expressions, which take all other texts."""

import random

import pytest
from pyspark.sql import functions as F

from veilwright.operators import ascii_scan
from veilwright.options import ScanOptions
from veilwright.plans import catalog
from veilwright.plans.scan import scan

PIECES = (
    "MARIO", "Rossi", "de", "Luca", "J", "J.", "Smith", "D'Angelo", "x-ray", "WU", "WS-MATRICOLA", "matr", "COD-DIP", "MOVE", "TO", "VALUE", "PIC X(7)", "5123456", "'6123456'", "123456", "0212345678",
    "TEL", "cell:", "Telefono =", "+39 (02) 123-456/78", "IT60X0542811101000000123456", "AB12CDEFGHIJKLMNO", "RSSMRA80A01H501U", "rossi.mario@example.com", "a@b", "http://ROSSI.it/x", "<", ">", ";", ",", "(", ")",
    "DISPLAY ", " AUTHOR", "REFERENTE", "//*", "*", "      *", "'", "\"", "'MARIO  ROSSI'", "_", "-", ":", "=", ".", "@", "://",
)
GAPS = (" ", " ", " ", "", "  ", "\t", "\n", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1e", "\x1f", "\n      * ", "\n* ")
NAMES = ("Mario", "Rossi", "De Luca", "J Smith", "D'Angelo", "Wu", "x-ray", "'MARIO")
CASES = {
    "all": ScanOptions(names=NAMES),
    "both lists": ScanOptions(names=NAMES[:3], roster_names=("Mario Rossi", "Rossi Mario", "Wu", "J Smith")),
    "whole": ScanOptions(entities=frozenset(["NAME", "EMAIL"]), names=NAMES, scope="all"),
    "long list": ScanOptions(entities=frozenset(["NAME", "MATRICOLA"]), names=(*NAMES, *(f"Nome{k}" for k in range(100)))),
    "no names": ScanOptions(entities=frozenset(["PHONE", "IBAN", "CODICE_FISCALE", "MATRICOLA"])),
}


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(11)
    own = ["".join(r.choice(PIECES) + r.choice(GAPS) for _ in range(r.choice((1, 3, 10, 40, 120)))) for _ in range(1500)]
    own += ["", None, "\n", "x" * 300 + "@y ROSSI", "* " + "y" * 300 + "\rROSSI@" + "z" * 300, "* ROSSI" + ".z" * 200 + "@it", "* caffè MARIO ROSSI TEL 0212345678", "* K ROSSI a@b.it"]
    own += ["\n".join(f"{'      * ' if k % 2 else 'x '}MARIO ROSSI TEL 02{k:08d} {'a' * (k % 40)}@b.it" for k in range(400))]
    return spark.createDataFrame(list(enumerate(own)), "k int, text string").select(F.concat(F.lit("f"), "k").alias("file"), "text").repartition(4).cache()


@pytest.mark.parametrize("case", [*CASES, "roster"])
def test_equals_the_expressions(spark, texts, monkeypatch, case):
    numbers = spark.createDataFrame([("5123456",), ("123456",)], "matricula string")
    options = CASES.get(case) or ScanOptions(entities=frozenset(["MATRICOLA", "PHONE"]), roster=numbers)
    got = sorted(map(tuple, scan(texts, options).collect()))
    monkeypatch.setattr(ascii_scan, "covers", lambda _: False)
    want = sorted(map(tuple, scan(texts, options).collect()))
    assert len(want) > 500 and got == want, (list(set(got) - set(want))[:3], list(set(want) - set(got))[:3])


def test_other_texts_and_options_are_left(texts):
    rows = ascii_scan.with_done(texts, CASES["all"], ["entity_type"]).join(texts.withColumnRenamed("text", "t"), "file").collect()
    assert all(r.done == (r.t is not None and r.t.isascii()) and r.text == ("" if r.done else r.t) for r in rows) and not all(r.done for r in rows)
    assert not ascii_scan.covers(ScanOptions(names=("Nicolò",))) and not ascii_scan.covers(ScanOptions(unknown_names=True)) and not ascii_scan.covers(ScanOptions(recognizer=len))


def test_wanted_columns_alone(texts):
    got = scan(texts, CASES["all"], ["file", "entity_type", "line_no"])
    assert got.columns == ["file", "entity_type", "line_no"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scan(texts, CASES["all"]).select(*got.columns).collect()))


@pytest.mark.parametrize("query", ["finding_totals", "occurrence_keys", "names_report"])
def test_queries_work_out_no_context(spark, smoke, monkeypatch, query):
    asked, scanned = [], ascii_scan.with_done
    monkeypatch.setattr(ascii_scan, "with_done", lambda texts, options, fields: asked.append(fields) or scanned(texts, options, fields))
    catalog.queries()[query](spark, smoke)
    assert len(asked) == 1 and "context" not in asked[0]
