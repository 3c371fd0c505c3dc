import hashlib
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import order, pairs, prose
from veilwright.llm import suffix_dedup
from veilwright.llm.induced import sorted_suffixes, suffix_array

LAST = 2**63 - 1


def gone(rows):
    """Which bytes of each row go."""
    first = {}
    for k, t in rows:
        raw, k = t.encode(), LAST if k is None else k
        for a in range(len(raw) - 49):
            w = raw[a : a + 50]
            if k < first.get(w, LAST + 1):
                first[w] = k
    out = []
    for k, t in rows:
        raw, k = t.encode(), LAST if k is None else k
        mask = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49):
            if first[raw[a : a + 50]] < k:
                mask[a : a + 50] = True
        out.append(mask)
    return out


def brute(rows):
    out = []
    for (k, t), mask in zip(rows, gone(rows), strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        out.append((k, len(raw), int(mask.sum()), spans, hashlib.sha256(raw[~mask].tobytes()).hexdigest()))
    return order(out)


def result(df):
    return order((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("which", ["edge", "smoke_docs", "empty"])
def test_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    assert result(suffix_dedup.removals(docs)) == brute(pairs(docs))


def test_small_blocks_and_spilled_queues(smoke_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 20_000)
    assert result(suffix_dedup.removals(smoke_docs, limit=1000)) == brute(pairs(smoke_docs))


@pytest.mark.parametrize("common", [1, 3])
def test_common_anchors_go_window_by_window(spark, smoke_docs, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 20_000)
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    monkeypatch.setattr(suffix_dedup, "KINDS", 0)
    assert result(suffix_dedup.removals(smoke_docs)) == brute(pairs(smoke_docs))
    line = "This is one very common line that many of the texts do have."
    rows = [(k, f"{prose(6, k)} {line} {prose(6, 500 + k)} {line if k % 3 else ''}") for k in range(300)]
    monkeypatch.undo()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(suffix_dedup.removals(docs)) == brute(rows)


def cut_brute(rows):
    out = []
    for (k, t), mask in zip(rows, gone(rows), strict=True):
        if not t or not mask.all():
            out.append((k, np.frombuffer(t.encode(), np.uint8)[~mask].tobytes().decode("utf-8", "ignore")))
    return order(out)


def test_cut(edge, empty, smoke_docs):
    for docs in (edge, empty, smoke_docs):
        got = suffix_dedup.cut(docs)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        assert order(pairs(got)) == cut_brute(pairs(docs))


def test_prefixes_of_high_bytes():
    for a, b in ((b"\x00" * 8, b"\xff" * 8), (b"q" + b"\x00" * 7, b"q" + b"\xff" * 7)):
        text = np.frombuffer(b"z" + a + b"z" + b + b"zy", np.uint8)
        order_, common = suffix_array(text, 16)
        raw = text.tobytes()
        for k in range(1, len(order_)):
            assert common[k] == shared(raw[order_[k] :].ljust(16, b"\0")[:16], raw[order_[k - 1] :].ljust(16, b"\0")[:16])


def shared(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(b"ab\x00c\xff"), max_size=160), st.sampled_from([10, 1 << 20]), st.sampled_from([5, 16, 50]))
def test_suffix_array_and_common_prefixes(values, limit, depth):
    raw = bytes(values)
    order_, common = suffix_array(np.array(values, np.uint8), depth, limit)
    assert sorted(order_.tolist()) == list(range(len(raw)))
    keys = [raw[k : k + depth].ljust(depth, b"\0") for k in order_.tolist()]
    assert keys == sorted(keys)
    ends = [min(depth, len(raw) - k) for k in order_.tolist()]
    for k in range(1, len(keys)):  # past the end of the text zeros may or may not count
        own = shared(keys[k], keys[k - 1])
        assert common[k] == own or own >= min(ends[k], ends[k - 1]) <= common[k] <= depth


@pytest.mark.parametrize("limit", [1000, 100_000])
def test_runs_of_leftmost_suffixes_are_merged(limit):
    r = np.random.default_rng(limit)
    text = np.concatenate([r.integers(97, 101, 40_000, dtype=np.uint8)] * 2 + [np.full(3000, 97, np.uint8), r.integers(0, 256, 20_000, dtype=np.uint8)])
    small, large = suffix_array(text, 50, limit), suffix_array(text, 50)
    raw = text.tobytes() + bytes(50)
    assert [raw[k : k + 50] for k in small[0].tolist()] == [raw[k : k + 50] for k in large[0].tolist()]
    keys = [raw[k : k + 50] for k in small[0].tolist()]
    for k in range(1, len(keys)):
        if max(small[0][k], small[0][k - 1]) < len(text) - 50:
            assert small[1][k] == shared(keys[k], keys[k - 1])


def test_a_shard_far_larger_than_memory(tmp_path):
    """Six MB of text in a mapped file, with a limit of a quarter MB: what is allocated does not follow the text's size."""
    path = tmp_path / "text"
    r = np.random.default_rng(4)
    words_ = [bytes(r.integers(97, 123, int(n), dtype=np.uint8)) for n in r.integers(2, 9, 3000)]
    with path.open("wb") as f:
        for _ in range(6):
            f.write(b" ".join(words_[k] for k in r.integers(0, len(words_), 170_000))[: 1 << 20])
    text = np.memmap(path, np.uint8, "r")
    tracemalloc.start()
    n, before, own = 0, None, 1 << 18
    for start, common in sorted_suffixes(text, 50, own):
        n += len(start)
        for k in (0, len(start) // 2, len(start) - 1):
            key = text[start[k] : start[k] + 50].tobytes().ljust(50, b"\0")
            assert before is None or before <= key
            before = key
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) and peak < 40 << 20  # in memory it takes over 40 bytes a byte
