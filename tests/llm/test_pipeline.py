"""The stages against brute-force forms of each, one after another."""

from tests.llm.conftest import order, pairs
from tests.llm.test_exact_dedup import keep_brute
from tests.llm.test_langid import brute as naive_bayes
from tests.llm.test_packing import check
from tests.llm.test_simhash import jaccard
from tests.llm.test_suffix_dedup import cut_brute

import corpus_pipeline as pipeline

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stages(spark, docs, sf_dir):
    """The input and output rows of each stage."""
    from veilwright.llm import _io

    out = []
    for name, stage in pipeline.STAGES:
        new = _io.stash(stage(spark, docs, sf_dir), name)
        out.append((name, docs, new))
        docs = new
    return out


def verify(spark, docs, smoke):
    done = {name: (a, b) for name, a, b in stages(spark, docs, smoke)}
    for name in ("language", "exact", "near", "passages"):
        assert done[name][1].columns == docs.columns
    (a, b) = done["language"]
    kept = pairs(b)
    assert all(any(c.isalpha() for c in t) for _, t in kept)
    rows = [(r.doc_id, r.text, r.lang) for r in a.collect()]
    if sum(len(t or "") for _, t, _ in rows) < 500_000:
        want = [(k, t or "") for (k, t, _), (_, lang, score) in zip(rows, naive_bayes(rows), strict=True) if lang != "und" and score >= pipeline.LEAST_SCORE]
        assert order(kept) == order(want)
    (a, b) = done["exact"]
    assert order((k, t.translate(LOWER)) for k, t in pairs(b)) == keep_brute(pairs(a))
    (a, b) = done["near"]
    before, after = pairs(a), pairs(b)
    assert set(after) <= set(before) and len(after) == len(set(after))
    for k, t in set(before) - set(after):  # what goes has a near copy
        assert any(jaccard(t.lower(), u.lower()) >= 0.8 for m, u in before if (m, u) != (k, t))
    assert not [1 for i, (_, t) in enumerate(after) for _, u in after[:i] if jaccard(t.lower(), u.lower()) >= 0.8]
    (a, b) = done["passages"]
    assert order(pairs(b)) == cut_brute(pairs(a))
    assert all(r.n_chars == len(r.text) for r in b.collect())
    (a, b) = done["packing"]
    check(b.collect(), pairs(a))


def test_smoke(spark, smoke_docs, smoke):
    verify(spark, smoke_docs, smoke)


def test_edge_rows(spark, edge, smoke):
    verify(spark, edge, smoke)


def test_empty(spark, empty, smoke):
    for _, _, b in stages(spark, empty, smoke):
        assert b.collect() == []


def test_run(spark, smoke):
    rows = pipeline.run(spark, smoke).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
