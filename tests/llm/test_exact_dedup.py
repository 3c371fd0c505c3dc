import hashlib
from collections import defaultdict

import pytest

from tests.llm.conftest import EDGE, order, pairs
from veilwright.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t.translate(LOWER)].append(k)
    out = []
    for k, t in rows:
        ids = groups[t.translate(LOWER)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((k, keep, len(ids), k == keep, hashlib.sha256(t.translate(LOWER).encode()).hexdigest()))
    return order(out)


def result(df):
    return order((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("which", ["edge", "smoke_docs", "empty"])
def test_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    assert result(exact_dedup.duplicates(docs)) == brute(pairs(docs))


def test_a_shared_identifier_is_found_and_replaced(smoke_docs):
    weak = lambda body: bytes([len(body) % 7])
    assert result(exact_dedup.duplicates(smoke_docs, ladder=(weak, exact_dedup.long_id))) == brute(pairs(smoke_docs))
    with pytest.raises(ValueError):
        exact_dedup.duplicates(smoke_docs, ladder=(weak,))


def keep_brute(rows):
    """One row for each text: that of the largest id."""
    best = {}
    for k, t in rows:
        key = t.translate(LOWER)
        if key not in best or best[key] is None or k is not None and k > best[key]:
            best[key] = k
    return order((k, t) for t, k in best.items())


def test_keep_one(edge, empty, smoke_docs):
    for docs in (edge, empty, smoke_docs):
        got = exact_dedup.keep_one(docs)
        assert got.columns == docs.columns
        assert order((k, t.translate(LOWER)) for k, t in pairs(got)) == keep_brute(pairs(docs))
    assert len(EDGE) > exact_dedup.keep_one(edge).count()
