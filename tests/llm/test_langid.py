import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import EDGE, order, pairs
from veilwright.llm import langid


def test_contract_and_held_out_accuracy(spark, smoke):
    sf = smoke.replace("sf0.001", "sf0.01")
    rows = langid.op10(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        own = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        has = any(c.isalpha() for c in own.text or "")
        assert (r.lang_pred == "und") == (not has)
        if r.held_out and has and own.lang:
            total += 1
            right += r.lang_pred == own.lang
    assert right >= 0.97 * total


def test_held_out_rows_teach_nothing(spark, smoke_docs):
    from pyspark.sql import functions as F

    seen = langid.train(smoke_docs.filter(~langid.held_out()))
    spoiled = smoke_docs.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    again = langid.train(spoiled.filter(~langid.held_out()))
    (a,), (b,) = seen.parts(), again.parts()
    assert a.languages == b.languages and (a.logs == b.logs).all()


def test_edge_rows(edge, empty, smoke_docs):
    model = langid.train(edge)
    assert [p.languages for p in model.parts()] == [("de", "en", "es", "fr")]
    got = langid.predict(edge, model).collect()
    assert len(got) == len(EDGE)
    und = [r.doc_id for r in got if r.lang_pred == "und"]
    assert order(und) == order(k for k, t in pairs(edge) if not any(c.isalpha() for c in t))
    assert langid.predict(empty, model).collect() == []
    none = langid.train(empty)
    assert list(none.parts()) == [] and {r.lang_pred for r in langid.predict(edge, none).collect()} == {"und"}


def test_keep_known(edge, smoke_docs):
    model = langid.train(smoke_docs)
    kept = langid.keep_known(edge, model, 0.0)
    assert kept.columns == edge.columns
    assert order(pairs(kept)) == order((k, t) for k, t in pairs(edge) if any(c.isalpha() for c in t))


def grams(text):
    """Hashed n-grams of 1 to 4 characters, one by one in whole numbers."""
    folded = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
    out = []
    for order in (1, 2, 3, 4):
        for k in range(len(folded) - order + 1):
            own = folded[k : k + order]
            if order == 1 and own[0] == 32 or any(x == y == 32 for x, y in zip(own, own[1:], strict=False)):
                continue
            code = 0
            for c in own:
                code = (code * 0x100000001B3 + c + 1) % 2**64
            out.append((code + order) * 0x9E3779B97F4A7C15 % 2**64 >> 47)
    return out


def brute(rows):
    """Multinomial naive Bayes with add-half smoothing and equal priors; the posterior of at most 64 n-grams' weight."""
    counts = {}
    for _, text, lang in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text or ""))
    total = {x: sum(c.values()) + 0.5 * 2**17 for x, c in counts.items()}
    out = []
    for key, text, _ in rows:
        own = grams(text or "")
        if not any(c.isalpha() for c in text or ""):
            out.append((key, "und", 0.0))
            continue
        logs = {x: sum(math.log((counts[x][g] + 0.5) / total[x]) for g in own) for x in sorted(counts)}
        best = max(logs, key=logs.get)
        out.append((key, best, 1 / sum(math.exp((v - logs[best]) * 64 / max(64, len(own))) for v in logs.values())))
    return out


@pytest.mark.parametrize("group", [1, 3, 32])
def test_equals_brute_force_with_any_number_of_languages_at_a_time(spark, smoke_docs, group):
    rows = [(r.doc_id, (r.text or "")[:1500], r.lang if r.doc_id % 3 else f"x{r.doc_id % 7}") for r in smoke_docs.limit(60).collect()] + [(900, "1 2", None), (901, None, "en"), (902, "ß", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs), group=group).collect()}
    for key, lang, score in brute(rows):
        assert got[key].lang_pred == lang and abs(got[key].score - score) < 1e-3, key
    kept = langid.keep_known(docs, langid.train(docs), 0.9, group=group)
    assert {r.doc_id for r in kept.collect()} == {k for k, x, score in brute(rows) if x != "und" and score >= 0.9}


def test_batches_do_not_change_a_score(spark, smoke_docs):
    (part,) = langid.train(smoke_docs).parts()

    texts = [r.text for r in smoke_docs.limit(40).collect()]
    together = part.totals(pa.array(texts))
    for k, text in enumerate(texts):
        alone = part.totals(pa.array([text]))
        assert np.allclose(alone[0][0], together[0][k]) and alone[1][0] == together[1][k]
