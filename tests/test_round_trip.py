"""Source trees in and out, lists and maps, reports, the command line, and streaming."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from veilwright.operators.groups import group_findings, ranked, replacement_map
from veilwright.options import ScanOptions
from veilwright.plans import anonymize
from veilwright.plans.scan import scan, scan_file, scan_path
from veilwright.sources import files, lists
from veilwright.streaming import ingest

TREE = {
    "A.CBL": b"      * AUTORE Mario Rossi\r\n       01 X VALUE 'Mario Rossi'.\r\n",
    "sub/B.cpy": "* referente Giulia è giulia@example.com\n* ancora GIULIA@example.com".encode("latin-1"),
    "sub/.hidden": b"* tel 021234567 a@b.it\n",
    "_under": b"a@b.it",
    "empty.txt": b"",
    "pic.png": bytes(range(256)),
    "roster.csv": b"5123456;Mario;Rossi\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    for name, raw in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    (tmp_path / "names.txt").write_text("# names\nMario\n  Rossi  \nGiulia\nGiulia\n\nDe   Luca\n")
    return root


def test_files(spark, tree):
    got = {r.file: r.text for r in files.texts(spark, str(tree), without=[str(tree / "roster.csv")]).collect()}
    assert set(got) == set(TREE) - {"pic.png", "roster.csv"}
    assert got["A.CBL"].count("\r") == 0 and "Giulia è" in got["sub/B.cpy"]
    assert [r.file for r in files.texts(spark, str(tree / "A.CBL")).collect()] == ["A.CBL"]
    assert {r.file for r in files.texts(spark, str(tree), skip=[str(tree / "sub")]).collect()} == {"A.CBL", "_under", "empty.txt", "roster.csv"}
    assert files.is_text("x.CBL") and files.is_text("dir.d/none") and not files.is_text("a.png") and files.is_text(".hidden")


def test_listing_goes_to_executors(spark, tmp_path):
    wanted = set()
    for k in range(40):
        for name in (f"d{k % 7}/e{k % 3}/f{k}.cbl", f"d{k % 7}/.h{k}", f"g{k}.PNG", f"d{k % 5}/x.y/_{k}."):
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(name)
            wanted.add(name)
    for most in (1, 10, 1000):
        rows = files.listed(spark, str(tmp_path), [str(tmp_path / "d1")], most).withColumn("t", files.has_text(F.col("file"))).collect()
        assert {r.file for r in rows} == {x for x in wanted if not x.startswith("d1/")} and all(r.size == len(r.file) for r in rows)
        assert all(r.t == files.is_text(r.file) for r in rows)


def test_lists(spark, tree, tmp_path):
    assert lists.load_names(spark, [str(tmp_path / "names.txt"), str(tmp_path / "absent")]) == ("De Luca", "Giulia", "Mario", "Rossi")
    roster = tmp_path / "r.txt"
    roster.write_text("matricola;nome;cognome\n5123456;Mario;Rossi\n654321;Petra;Van Ness\n555555;Wu\n666666;Di Re;x@y.it\n# c\nO\n")
    names, staff = lists.load_rosters(spark, [str(roster)])
    assert sorted(r.matricula for r in staff.collect()) == ["5123456", "555555", "654321", "666666"]
    assert set(names) == {"Mario Rossi", "Rossi Mario", "M Rossi", "Petra Van Ness", "P Van Ness", "Wu", "Di Re", "Re Di"}


def test_map_file(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("﻿entity_type,key,original,replacement\nEMAIL,A@B.IT,a@b.it,one\nEMAIL,A@B.IT,a@b.it,two\nIBAN,,it 1,x\nNAME,,Mario,y\nEMAIL,C@D.IT,,\n,K,,z\nNAME,\"k,\"\"1\"\"\n2\",n,q\n", encoding="utf-8")
    got = {(r.entity_type, r.key): r.replacement for r in lists.load_map(spark, str(path)).collect()}
    assert got == {("EMAIL", "A@B.IT"): "two", ("IBAN", "IT 1"): "x", ("NAME", 'k,"1"\n2'): "q"}
    assert lists.load_map(spark, None).collect() == []


def test_groups(spark):
    text = "".join(f"a@b.it A@B.IT line {k}\n" for k in range(10)) + "* z@z.it\n"
    own = scan(spark.createDataFrame([("f", text), ("g", "* b@b.it")], "file string, text string"), ScanOptions(entities=frozenset(["EMAIL"])))
    got = ranked(group_findings(own)).orderBy("index").collect()
    assert [(r["index"], r.key, r.original, r.hits) for r in got] == [(1, "A@B.IT", "a@b.it", 20), (2, "B@B.IT", "b@b.it", 1), (3, "Z@Z.IT", "z@z.it", 1)]
    assert got[0].locations == ", ".join(f"f:{k // 2 + 1}" for k in range(8)) + " +12 more"
    chosen = spark.createDataFrame([("EMAIL", "B@B.IT", "me")], "entity_type string, key string, replacement string")
    auto = {r.key: r.replacement for r in replacement_map(group_findings(own), "s", chosen, auto=True).collect()}
    assert auto == {"A@B.IT": "user001@example.invalid", "B@B.IT": "me", "Z@Z.IT": "user003@example.invalid"}


def test_more_than_999_groups(spark):
    rows = spark.range(1200).select(F.lit("EMAIL").alias("entity_type"), F.format_string("K%05d", "id").alias("key"), F.format_string("k%05d", "id").alias("original"), F.lit(1).alias("hits"), F.lit("").alias("locations"), F.lit("f").alias("first_file"), F.lit(0).alias("first_start")).repartition(7)
    got = replacement_map(rows, "s").orderBy("key").collect()
    assert [r["index"] for r in got] == list(range(1, 1201)) and got[1199].suggested_replacement == "user1200@example.invalid"


def run(spark, tree, *more):
    return anonymize.main([str(tree), "--salt", "s", "--no-presidio", "--watchlist", str(tree.parent / "names.txt"), *more], spark)


def test_anonymize(spark, tree, capsys):
    out = tree.parent / "out"
    assert run(spark, tree, "--out-dir", str(out), "--auto", "--employee-roster", str(tree / "roster.csv")) == 0
    assert {os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs} == set(TREE) - {"roster.csv"}
    assert (out / "pic.png").read_bytes() == TREE["pic.png"] and (out / "empty.txt").read_bytes() == b""
    first = (out / "A.CBL").read_text()
    assert first == "      * AUTORE Nome002 Cognome002\n       01 X VALUE 'Nome003 Cognome003'.\n"
    second = (out / "sub/B.cpy").read_text(encoding="utf-8")
    assert second.count("@example.invalid") == 2 and "giulia@" not in second.lower() and " è " in second
    report = tree.parent / "out_report"
    found = json.loads((report / "anonymization_findings.json").read_text())
    assert list(found[0]) == ["file", "entity_type", "text", "line", "column", "confidence", "context", "source"]
    assert [x["file"] for x in found] == sorted(x["file"] for x in found)
    rows = list(csv.DictReader((report / "replacement_map.csv").open()))
    assert all(r["replacement"] for r in rows) and {r["entity_type"] for r in rows} == {"NAME", "EMAIL", "PHONE"}
    again = scan(files.texts(spark, str(out)), ScanOptions(names=("Mario", "Rossi", "Giulia")))
    assert {r.text for r in again.filter("entity_type = 'NAME'").collect()} == set()


def test_review(spark, tree, capsys):
    path = tree.parent / "maps" / "m.csv"
    assert run(spark, tree, "--create-map", str(path)) == 0
    rows = list(csv.DictReader(path.open()))
    assert all(r["replacement"] == "" for r in rows)
    target = next(r for r in rows if r["key"] == "GIULIA@EXAMPLE.COM" and r["hits"] == "2")
    target["replacement"] = "someone"
    with path.open("w", newline="") as f:
        w = csv.DictWriter(f, rows[0].keys())
        w.writeheader()
        w.writerows(rows)
    assert run(spark, tree, "--map-file", str(path), "--auto") == 0
    assert (tree.parent / "in_anonymized/sub/B.cpy").read_text(encoding="utf-8").count("someone") == 2


def test_answers(spark, tree):
    own = replacement_map(group_findings(scan(files.texts(spark, str(tree)), ScanOptions(names=("Mario", "Rossi")))), "s")
    said = iter(["", "skip", "mine"])

    def answer(prompt):
        try:
            return next(said)
        except StopIteration:
            raise EOFError from None

    rows = own.orderBy("index").collect()
    got = {(r.entity_type, r.key): r.replacement for r in anonymize.ask(own, answer).collect()}
    assert len(got) == len(rows) - 1
    assert got[rows[0].entity_type, rows[0].key] == rows[0].suggested_replacement
    assert got[rows[2].entity_type, rows[2].key] == "mine"


def test_names_only_and_errors(spark, tree, capsys):
    assert run(spark, tree, "--names-only") == 0
    assert "Mario Rossi |  | A.CBL | 1 |" in capsys.readouterr().out
    rows = list(csv.DictReader((tree.parent / "in_anonymized_report/names_findings.csv").open()))
    assert rows[0]["confidence"] == "0.7000" and {r["folder"] for r in rows} == {"", "sub"}
    assert run(spark, tree, "--scan-only") == 0
    for bad in (["/does/not/exist"], [str(tree), "--out-dir", str(tree), "--salt", "x"], [str(tree)]):
        with pytest.raises(SystemExit) as e:
            anonymize.main(bad, spark)
        assert e.value.code == 2


def test_library_calls(spark, tree):
    options = ScanOptions(entities=frozenset(["EMAIL"]))
    got = {(r.file, r.text) for r in scan_path(spark, str(tree), options, without=[str(tree / "roster.csv")]).collect()}
    assert got == {("sub/B.cpy", "giulia@example.com"), ("sub/B.cpy", "GIULIA@example.com"), ("sub/.hidden", "a@b.it"), ("_under", "a@b.it")}
    one = scan_file(spark, str(tree / "sub/B.cpy"), options, str(tree)).collect()
    assert {r.file for r in one} == {"sub/B.cpy"} and len(one) == 2
    assert {r.file for r in scan_file(spark, str(tree / "sub/B.cpy"), options).collect()} == {"B.cpy"}


def test_stream(spark, tree, tmp_path):
    found = ingest.stream_findings(spark, str(tree), ScanOptions(entities=frozenset(["EMAIL"])))
    ingest.write_maps(found, "s", str(tmp_path / "maps"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "maps")).collect()
    assert {(r.key, r.locations) for r in got} == {("GIULIA@EXAMPLE.COM", "sub/B.cpy:1, sub/B.cpy:2")}


def test_stream_tells_equal_names_apart(spark, tmp_path):
    for name in ("a/X.CBL", "b/X.CBL"):
        (tmp_path / "in" / name).parent.mkdir(parents=True)
        (tmp_path / "in" / name).write_text("* MARIO\n")
    found = ingest.stream_findings(spark, str(tmp_path / "in"), ScanOptions(entities=frozenset(["NAME"]), names=("Mario",)))
    ingest.write_maps(found, "s", str(tmp_path / "maps"), str(tmp_path / "check")).awaitTermination(120)
    got = {r.key for r in spark.read.parquet(str(tmp_path / "maps")).collect()}
    assert got == {"OCCURRENCE:a/X.CBL:1:3:MARIO", "OCCURRENCE:b/X.CBL:1:3:MARIO"}
