import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import order, pairs, prose, with_clashes, SCHEMA
from veilwright.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_mark(text: str, width: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(marks: set[int], linked) -> dict[int, int]:
    parent = {m: m for m in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(marks), 2):
        if linked(a, b):
            parent[find(a)] = find(b)
    return {m: find(m) for m in marks}


def brute(rows):
    marks = [brute_mark(t) for _, t in rows]
    root = roots(set(marks), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (k, _), m in zip(rows, marks, strict=True):
        if k is not None:
            least[root[m]] = min(k, least.get(root[m], k))
    return order((k, f"{m:016x}", least.get(root[m])) for (k, _), m in zip(rows, marks, strict=True))


@pytest.mark.parametrize("which", ["edge", "smoke_docs", "empty"])
def test_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    got = order((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == brute(pairs(docs))


@pytest.mark.parametrize("split, agree", [(5, None), (5, 1), (2000, None), (2000, 2), (2000, 3)])
def test_links_connect_what_brute_force_connects(spark, split, agree):
    r = np.random.default_rng(1)
    seeds = r.integers(0, 2**63, 12, dtype=np.uint64)
    codes = {int(s) ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 4)), replace=False)) for s in seeds for _ in range(25)}
    codes |= {int(x) for x in r.integers(0, 2**63, 60, dtype=np.uint64)} | {(7 << 48) | k for k in range(40)}
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in codes], "fp long")
    found = {frozenset((x.a & (2**64 - 1), x.b & (2**64 - 1))) for x in simhash.links(df, split=split, agree=agree).collect()}
    same = roots(codes, lambda a, b: (a ^ b).bit_count() <= 3)
    ours = roots(codes, lambda a, b: frozenset((a, b)) in found)
    classes = lambda of: {frozenset(c for c in of if of[c] == x) for x in of.values()}
    assert classes(ours) == classes(same)


def test_gray_rank_orders_by_one_bit():
    rank = simhash.gray_rank(np.arange(256, dtype=np.uint64))
    path = np.argsort(rank)
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(path, path[1:], strict=False))


def words_changed(text: str, every: int) -> str:
    words = text.split()
    words[every // 2 :: every] = [w + "x" for w in words[every // 2 :: every]]
    return " ".join(words)


def jaccard(a: str, b: str, width: int = 5) -> float:
    x, y = ({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_keep_one_finds_near_copies_and_keeps_the_rest(spark):
    rows, near, clean = [], [], []
    for k in range(60):
        base = prose(120 + 9 * k, 100 + k)
        rows += [(10 * k, base, "en"), (10 * k + 1, words_changed(base, 60), "en"), (10 * k + 2, prose(100, 900 + k), "en")]
        half = base.split()
        rows.append((10 * k + 3, " ".join(half[: len(half) // 2]) + " " + prose(len(half) // 2, 2000 + k), "en"))
        near.append(10 * k + 1)
        clean += [10 * k, 10 * k + 2, 10 * k + 3]
        assert jaccard(base, words_changed(base, 60)) >= 0.8 and jaccard(base, rows[-1][1]) < 0.5
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(with_clashes(rows), SCHEMA)).collect()}
    assert set(clean) <= kept
    assert len(kept & set(near)) <= 3


def test_keep_one_on_edge_rows(edge, empty):
    assert simhash.keep_one(empty).collect() == []
    got = simhash.keep_one(edge)
    assert got.columns == edge.columns
    kept = order(pairs(got))
    assert len(kept) == len(set(kept))
    assert (5, "Another text with the same id.") in kept
    assert [k for k, t in kept if t == "a"] == [19]
    assert sum(k in (11, 12) for k, _ in kept) == 1


def star(seed: int, copies: int) -> list[str]:
    """An original and variants, each at 0.8 or more to it but not to one another."""
    base = prose(300, seed).split()
    out = [" ".join(base)]
    for k in range(copies):
        words, r = base.copy(), np.random.default_rng(1000 * seed + k)
        for at in np.sort(r.choice(30, 5, replace=False)):
            words[10 * int(at) + int(r.integers(0, 3))] += f"v{k}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("unit", [1 << 22, 6000])
def test_copies_alike_to_one_original_only_are_one_group(spark, monkeypatch, unit):
    monkeypatch.setattr(simhash, "UNIT", unit)
    rows, groups = [], 4
    for g in range(groups):
        texts = star(70 + g, 60)
        assert all(jaccard(texts[0], t) >= 0.8 for t in texts) and jaccard(texts[1], texts[2]) < 0.77
        rows += [(1000 * g + (900 if k == 0 else k), t, "en") for k, t in enumerate(texts)]
    got = simhash.keep_one(spark.createDataFrame(with_clashes(rows), SCHEMA).repartition(3))
    assert len(got.collect()) <= groups + 0.05 * len(rows)


def test_only_pairs_of_four_fifths_are_linked(spark):
    rows, apart, copies = [], [], []
    for k in range(150):
        words = prose(150 + k, 4000 + k).split()
        other = words.copy()
        for at in range(5, 5 + 5 * max(1, round(len(words) * (0.028, 0.02)[k % 2])), 5):
            other[at] += "x"
        text, new = " ".join(words), " ".join(other)
        rows += [(10 * k, text, "en"), (10 * k + 1, new, "en")]
        (copies if jaccard(text, new) >= 0.8 else apart).append(10 * k + 1)
        assert 0.7 <= jaccard(text, new) <= 0.9
    heavy = "the same line comes again and again " * 60
    rows += [(5000 + k, heavy + prose(12, 6000 + k), "en") for k in range(2)]
    assert jaccard(rows[-1][1], rows[-2][1]) < 0.5
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(with_clashes(rows), SCHEMA)).collect()}
    assert apart and copies and set(apart) <= kept and {5000, 5001} <= kept
    assert len(kept & set(copies)) <= 1
