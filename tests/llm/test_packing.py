import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import pairs
from veilwright.llm import packing
from veilwright.llm.queries import tokenizer_file
from veilwright.llm.tokenizer import load

PATH = tokenizer_file("byte_bpe_50k.json")
SIZE = packing.SIZE


def check(rows, docs, pack_size=SIZE):
    """Every id in one piece, windows gapless, whole and bounded; returns the share of padding."""
    ids = {}
    for k, t in docs:
        ids.setdefault(k, []).append([*load(PATH).encode(t, add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids)
    for k, own in ids.items():
        left = [(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[k]]
        for doc in own:
            at = 0
            while at < len(doc):
                hit = next(x for x in left if x[0] == at and x[3] == len(doc) and x[2] == zlib.crc32(np.array(doc[at : at + x[1]], "<u4").tobytes()))
                left.remove(hit)
                at += hit[1]
            assert at == len(doc)
        assert not left
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    total = padded = 0
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= pack_size
        total += at
        padded += 0 if at & (at - 1) == 0 else pack_size - at
    assert sorted(windows) == list(range(len(windows)))
    return padded / max(1, total + padded)


@pytest.mark.parametrize("which", ["edge", "smoke_docs"])
def test_pieces(which, request):
    docs = request.getfixturevalue(which)
    assert check(packing.pack(docs, PATH, 1).collect(), pairs(docs)) < 0.03


def test_small_segments_and_ids(smoke_docs):
    rows = packing.pack(smoke_docs, PATH, 1, segment_tokens=5000, with_ids=True).collect()
    check(rows, pairs(smoke_docs))
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_empty(empty):
    assert packing.pack(empty, PATH, 1).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 7), st.integers(0, 9)), min_size=1, max_size=12))
def test_cuts_cost_least(steps):
    at = np.concatenate([[0], np.cumsum([x for x, _ in steps])])
    penalty = np.array([0, *(c for _, c in steps[:-1]), 0])

    free = {1, 2, 4, 8, 12}
    pairs_of = {a + b for a in free for b in free if a >= 6 and b <= a}

    def stretch(n):
        """One window, padded to 12 or not, or two without padding."""
        one = packing.WINDOW_COST + (0 if n in free else 12 - n) if n <= 12 else float("inf")
        return min(one, 2 * packing.WINDOW_COST + packing.INNER_COST if n in pairs_of else float("inf"))

    def cost(places):
        return sum(stretch(b - a) for a, b in zip([0, *places], places, strict=False))

    last = len(at) - 1
    of = {int(a): int(c) for a, c in zip(at, penalty, strict=True)}
    best = min(cost(own) + sum(of[p] for p in own) for mask in range(0, 1 << last, 2) for own in [[int(at[j]) for j in range(1, last) if mask >> j & 1] + [int(at[last])]])
    ends = packing.plan_cuts(at, penalty, 12).tolist()
    inner = [e for e in ends if e not in of]
    windows = sum(packing.WINDOW_COST + (0 if b - a in free else 12 - (b - a)) for a, b in zip([0, *ends], ends, strict=False))
    assert all(0 < b - a <= 12 for a, b in zip([0, *ends], ends, strict=False))
    assert windows + sum(of.get(e, 0) for e in ends) + packing.INNER_COST * len(inner) <= best


def test_no_padding_where_one_cut_saves_it():
    at, penalty = np.array([0, 1024, 2049, 4097]), np.zeros(4, np.int64)
    assert packing.plan_cuts(at, penalty, 2048).tolist() == [2048, 2049, 4097]
