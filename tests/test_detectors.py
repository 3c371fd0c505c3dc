import re

import pytest
from pyspark.sql import functions as F

from veilwright.functions.text import collapsed, decoded
from veilwright.operators import detectors, ranges
from veilwright.options import ScanOptions
from veilwright.plans.scan import scan

NAMES = ("Mario", "Rossi", "Giulia", "Bianchi", "De Luca", "Anna Maria", "J Smith", "D'Angelo", "Wu")
SOURCE = """\
       IDENTIFICATION DIVISION.
      * AUTORE: Mario  Rossi, tel 02 1234567
       01 WS-NOME PIC X(20) VALUE 'Giulia Bianchi'.
       MOVE Mario TO X.
      * scrivere a mario.rossi@example.com, vedi http://rossi.example.com/x
       MOVE '5123456' TO WS-MATRICOLA.
       01 EMP-ID-1 PIC X VALUE 654321.
      * MATR = 7654321X MATR: 998877
       MOVE 'RSSMRA80A01H501U' TO WS-CF.
      * IBAN IT60X0542811101000000123456 TELEFONO: +39 (02) 555-1234
      * J. Smith e De
      * Luca, De Luca; anna
\t maria
"""


def found(spark, text, **options):
    rows = scan(spark.createDataFrame([("f", text)], "file string, text string"), ScanOptions(**options)).collect()
    for r in rows:
        assert text[r.start : r.end].strip() == r.text or r.source == "unknown_name_heuristic"
        assert r.line_no == text.count("\n", 0, r.start) + 1 and r.col_no == r.start - (text.rfind("\n", 0, r.start) + 1) + 1
        assert r.context == text[max(0, r.start - 75) : r.start] + "[[" + text[r.start : r.end] + "]]" + text[r.end : r.end + 75]
    return [(r.line_no, r.entity_type, r.text, r.confidence, r.source) for r in sorted(rows, key=lambda r: r.start)]


def test_all_detectors(spark):
    got = found(spark, SOURCE, names=NAMES)
    assert got == [
        (2, "NAME", "Mario  Rossi", 0.70, "watchlist"),
        (2, "PHONE", "02 1234567", 0.78, "regex"),
        (3, "NAME", "Giulia Bianchi", 0.70, "watchlist"),
        (5, "EMAIL", "mario.rossi@example.com", 0.98, "regex"),
        (6, "MATRICOLA", "5123456", 0.84, "regex"),
        (7, "MATRICOLA", "654321", 0.84, "regex"),
        (8, "MATRICOLA", "998877", 0.84, "regex"),
        (9, "CODICE_FISCALE", "RSSMRA80A01H501U", 0.96, "regex"),
        (10, "IBAN", "IT60X0542811101000000123456", 0.96, "regex"),
        (10, "PHONE", "+39 (02) 555-1234", 0.78, "regex"),
        (11, "NAME", "J. Smith", 0.70, "watchlist"),
        (12, "NAME", "De Luca", 0.70, "watchlist"),
    ]


def test_roster_tells_staff_numbers(spark):
    got = found(spark, "000100 MOVE 5123456. X1234567 654321", entities=frozenset(["MATRICOLA"]), roster=spark.createDataFrame([("5123456",), ("5123456",), ("7000000",)], "matricula string"))
    assert got == [(1, "SUSPECTED_MATRICOLA", "000100", 0.68, "not_in_employee_roster"), (1, "MATRICOLA", "5123456", 0.99, "employee_roster"), (1, "SUSPECTED_MATRICOLA", "654321", 0.68, "not_in_employee_roster")]


def test_roster_names_and_ties(spark):
    got = found(spark, "* Wu e Petra Rossi\n", entities=frozenset(["NAME"]), names=("Rossi", "Wu"), roster_names=("Wu", "Petra Rossi", "Rossi"))
    assert got == [(1, "NAME", "Wu", 0.92, "employee_roster"), (1, "NAME", "Petra Rossi", 0.92, "employee_roster")]
    got = found(spark, "* Rossi\n", entities=frozenset(["NAME"]), names=("Rossi",), roster_names=("Rossi",))
    assert got == [(1, "NAME", "Rossi", 0.70, "watchlist")]


def test_scope_all(spark):
    got = found(spark, SOURCE, entities=frozenset(["NAME"]), names=NAMES, scope="all")
    assert (4, "NAME", "Mario", 0.70, "watchlist") in got and (11, "NAME", "De\n      * Luca", 0.7, "watchlist") not in got


def test_unknown_names(spark):
    text = "* SIG. D’ANGELO E FERRARI VALIDAZIONE ERRORE\n       ASSIGN 'COLOMBO' VERDI\n      * GALLO SQLCODE\n      * PEDIMENTO\n DISPLAY 'SEGNALARE A GRECO'\n* x MARINI@e.it\n"
    got = found(spark, text, entities=frozenset(["NAME"]), unknown_names=True)
    assert got == [
        (1, "NAME", "D'ANGELO", 0.72, "unknown_name_heuristic"),
        (1, "NAME", "FERRARI", 0.68, "unknown_name_heuristic"),
        (3, "NAME", "GALLO", 0.58, "unknown_name_heuristic"),
        (5, "NAME", "GRECO", 0.68, "unknown_name_heuristic"),
    ]


def alternation(names, least):
    """The list as one pattern, longest first, for words that may be split by blanks."""
    parts = []
    for name in sorted(names, key=lambda n: (-len(n), n.upper())):
        words = name.split()
        if len(words) == 1:
            if len(name) >= least:
                parts.append(re.escape(name))
        else:
            parts.append(r"\s+".join(re.escape(w) + (r"\.?" if len(w) == 1 else "") for w in words))
    return re.compile(rf"(?<![\w-])(?:{'|'.join(parts)})(?![\w-])", re.I)


@pytest.mark.parametrize("least", [2, 3])
def test_pruned_pattern_equals_whole_alternation(spark, least):
    texts = ["mario-rossi Mario_Rossi MARIO rossi", "de  luca De\tLuca DELUCA", "j smith J. Smith j.smith", "d'angelo D'ANGELO' x", "wu WU-1 Wu", "anna\nmaria anna", "", "ROSSI,BIANCHI;Giulia"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file string, text string")
    spans = detectors.with_pattern(df, "p", NAMES, least).select("text", F.when(F.col("p").isNotNull(), detectors.matches(F.col("text"), F.col("p"))).alias("s")).collect()
    for r in spans:
        assert [(x.start, x.end) for x in r.s or []] == [m.span() for m in alternation(NAMES, least).finditer(r.text)], r.text


def test_context_lines(spark):
    lines = ["* a", "//* b", "      * c", "       DISPLAY 'x'", "  DISPLAYED", "01 X VALUE 1", "VALUE", "x AUTHOR y", "", "      *", "00010*x", "cognome"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select("line", ranges.name_line(F.col("line")).alias("n"), ranges.comment_line(F.col("line")).alias("c")).collect()
    assert {r.line for r in got if r.c} == {"* a", "//* b", "      * c", "      *"}
    assert {r.line for r in got if r.n} == {"* a", "//* b", "      * c", "       DISPLAY 'x'", "01 X VALUE 1", "x AUTHOR y", "      *", "cognome"}


def test_recognizer_adapter(spark):
    text = "* Responsabile Mario Rossi e DISPLAY Bianchi 12\n Verdi Paolo fuori\n"

    def people(t):
        return [(t.index("Responsabile"), t.index(" e DISPLAY"), 0.85), (t.index("DISPLAY"), t.index(" 12"), 0.85), (t.index("Verdi"), t.index(" fuori"), 0.85)]

    got = found(spark, text, entities=frozenset(["NAME"]), recognizer=people)
    assert got == [(1, "NAME", "Mario Rossi", 0.85, "presidio_spacy")]

    def broken(t):
        raise RuntimeError

    assert found(spark, text, entities=frozenset(["NAME"]), recognizer=broken) == []


def test_decoding(spark):
    raw = [b"a\r\nb\rc\n", "caffè".encode(), "caffè".encode("latin-1"), b"", "﻿x".encode()]
    got = [r.t for r in spark.createDataFrame([(x,) for x in raw], "c binary").select(decoded(F.col("c")).alias("t")).collect()]
    assert got == ["a\nb\nc\n", "caffè", "caffè", "", "﻿x"]
    assert spark.range(1).select(collapsed(F.lit(" a\t\x1c b c ")).alias("t")).first().t == "a b c"


def test_options_are_checked():
    with pytest.raises(ValueError):
        ScanOptions(scope="some")
    with pytest.raises(ValueError):
        ScanOptions(entities=frozenset(["X"]))
