"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

_R = random.Random(3)
_WORDS = ["".join(_R.choice("abcdefghijklmnop") for _ in range(_R.randint(2, 8))) for _ in range(4000)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) for _ in range(n))


LONG = prose(40_000, 1)
PASSAGE = prose(30, 2)
#: (doc_id, text, lang)
EDGE = [
    (5, "The quick brown fox jumps over the lazy dog and the cat.", "en"),
    (5, "The quick brown fox jumps over the lazy dog and the cat.", "en"),
    (5, "Another text with the same id.", "en"),
    (7, "the QUICK brown fox jumps over the lazy dog and the cat.", None),
    (8, None, None),
    (9, "", "fr"),
    (10, "   \t\n ", "fr"),
    (11, LONG, "en"),
    (12, LONG[:-40] + " changed tail of the very long text here", "en"),
    (13, f"{prose(20, 4)} {PASSAGE} {prose(20, 5)}", "es"),
    (14, f"{prose(20, 6)} {PASSAGE}", "es"),
    (15, PASSAGE, None),
    (None, f"{PASSAGE} {prose(8, 7)}", "de"),
    (None, None, None),
    (16, "Straße, café — naïve 😀 text̀ with\x00 control \x85 chars and 漢字 <|endoftext|> end", "de"),
    (17, "<|startoftext|> it's we'll  two  spaces\n\nlines\r\n trailing ", "fr"),
    (18, "x" * 5000, None),
    (19, "a", "en"),
    (20, "a", "en"),
    (21, "12345 67,890 -- !!", None),
    (22, "ab" * 400, "en"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, recipe string, block int, sub int, payload string, ids array<int>, c0 string, tie string, group string, start int, __text string"


def with_clashes(rows):
    return [(i, t, g, "src", len(t or ""), 1, "r", k, None, "p", [k], "c", None, "g", 3, "u") for k, (i, t, g) in enumerate(rows)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(with_clashes(EDGE), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def smoke_docs(spark, smoke):
    return spark.read.parquet(f"{smoke}/documents.parquet").cache()


def pairs(df) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=repr)
