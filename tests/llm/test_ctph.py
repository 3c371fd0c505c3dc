import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import order, pairs, prose
from veilwright.llm import ctph


def signature_brute(raw: bytes) -> str:
    """Byte by byte in whole numbers: trigger hash of seven bytes, chunks, a character for each."""
    n = len(raw)
    if not n:
        return "3::"
    table = [int(x) for x in np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rolls, mixed = [], []
    for k in range(n):
        last = raw[max(0, k - 6) : k + 1][::-1]
        turned = 0
        for age, byte in enumerate(last):
            turned ^= (byte << (5 * age)) % 2**32
        rolls.append((sum(last) + sum(byte * (7 - age) for age, byte in enumerate(last)) + turned) % 2**32)
        mixed.append(table[raw[k]] ^ ((table[raw[k - 1]] << 1) % 2**64 if k > 0 else 0) ^ (table[raw[k - 2]] >> 1 if k > 1 else 0))

    def places(block):
        return [k for k in range(n) if rolls[k] % block == block - 1]

    def signature(ends):
        ends = [x + 1 for x in ends]
        if not ends or ends[-1] < n:
            ends.append(n)
        out, begin = "", 0
        for end in ends:
            h = sum(mixed[begin:end]) * 0x9E3779B97F4A7C15 % 2**64 ^ (end - begin) * 0xC2B2AE3D27D4EB4F % 2**64
            out += letters[(h ^ h >> 29) * 0x9E3779B97F4A7C15 % 2**64 >> 58]
            begin = end
        return out

    block = 3
    while block * 64 < n:
        block *= 2
    while len(places(block)) < 32 and block > 3:
        block //= 2
    while len(places(block)) > 128:
        block *= 2
    return f"{block}:{signature(places(block))}:{signature([k for k in places(block) if rolls[k] % (2 * block) == 2 * block - 1])}"


def common_length(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def likeness_brute(a: str, b: str) -> float:
    def compare(x, y):
        if x == y:
            return 1.0
        x, y = (re.sub(r"(.)\1{3,}", r"\1\1\1", s) for s in (x, y))
        if not x or not y or min(len(x), len(y)) >= 7 and not any(x[k : k + 7] in y for k in range(len(x) - 6)):
            return 0.0
        return 2 * common_length(x, y) / (len(x) + len(y))

    if a == b:
        return 1.0
    (p, x1, x2), (q, y1, y2) = a.split(":"), b.split(":")
    sizes_a, sizes_b = {int(p): x1, 2 * int(p): x2}, {int(q): y1, 2 * int(q): y2}
    return max((compare(sizes_a[k], sizes_b[k]) for k in sizes_a.keys() & sizes_b.keys()), default=0.0)


def test_against_next_on_unique_ids(smoke_docs):
    docs = smoke_docs.limit(120)
    rows = sorted(pairs(docs))
    want = []
    for k, (key, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        own, changed, next_ = (signature_brute(x.encode()) for x in (text, new, after))
        want.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed, round(likeness_brute(own, changed), 9), round(likeness_brute(own, next_), 9)))
    got = ctph.against_next(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert order((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == order(want)
    edited = [r.near_edited for r in got if r.n_chars > 200]
    assert sum(x >= 0.4 for x in edited) >= 0.9 * len(edited)
    assert sum(r.near_next > 0.3 for r in got) <= 0.1 * len(got)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=400), st.text("ab \n", max_size=3000).map(str.encode)))
def test_fingerprint_equals_brute_force(raw):
    assert ctph.fingerprint(raw) == signature_brute(raw)


def test_edge_rows(edge, empty):
    got = ctph.against_next(edge).collect()
    assert order((r.doc_id, r.fingerprint) for r in got) == order((k, ctph.fingerprint(t.encode())) for k, t in pairs(edge))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert ctph.against_next(empty).collect() == []
    assert order((r.doc_id, r.fingerprint) for r in ctph.fingerprints(edge).collect()) == order((r.doc_id, r.fingerprint) for r in got)


def test_lone_row(spark):
    (r,) = ctph.against_next(spark.createDataFrame([(1, "only text here")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_edit_likeness(a, b):
    got = ctph.edit_likeness(a, b)
    assert 0 <= got <= 1 and got == ctph.edit_likeness(b, a)
    x, y = ctph._RUN.sub(r"\1\1\1", a), ctph._RUN.sub(r"\1\1\1", b)
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
    if got not in (0.0, 1.0):
        assert got == pytest.approx(2 * table[-1][-1] / (len(x) + len(y)))


def test_a_small_edit_keeps_most_of_the_signature():
    text = prose(3000, 11)
    for k in (0, 5000, len(text) - 20):
        other = text[:k] + "something else " + text[k:]
        assert ctph.likeness(ctph.fingerprint(text.encode()), ctph.fingerprint(other.encode())) > 0.9
    assert ctph.likeness(ctph.fingerprint(text.encode()), ctph.fingerprint(prose(3000, 12).encode())) < 0.2
