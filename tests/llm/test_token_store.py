import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import order, pairs
from veilwright.llm import token_store
from veilwright.llm.queries import tokenizer_file
from veilwright.llm.tokenizer import load

PATH = tokenizer_file("word_bpe_49k.json")


def expected(text: str) -> tuple[int, int]:
    ids = [*load(PATH).encode(text, add_special_tokens=False).ids, 2]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["edge", "smoke_docs"])
def test_read_back_equals_library(which, request):
    docs = request.getfixturevalue(which)
    rows = token_store.write_store(docs, PATH, 2, shard_tokens=3000).documents(docs, step_tokens=5000).collect()
    assert order((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == order((k, *expected(t)) for k, t in pairs(docs))
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)


def test_read_back_is_spread(smoke_docs):
    store = token_store.write_store(smoke_docs, PATH, 2, shard_tokens=3000)
    assert store.shards > 8 and store.documents(smoke_docs).rdd.getNumPartitions() == store.shards


def found(rows):
    return order((r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows)


def test_lookup(spark, edge):
    """Strangers, null, repeated keys, and the extreme keys beside null."""
    low, high = -(2**63), 2**63 - 1
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(low, "the least key"), (high, "the largest key"), (high, "again")], "doc_id long, text string"))
    store = token_store.write_store(docs, PATH, 2, shard_tokens=500)
    ask = lambda *keys: store.lookup(spark.createDataFrame([(k,) for k in keys], "doc_id long")).collect()
    want = lambda *keys: order((k, *expected(t)) for k, t in pairs(docs) if k in keys)
    assert found(ask(5, 19, 999, None, -7)) == want(5, 19, None)
    assert found(ask(low)) == want(low) and len(ask(None)) == 2
    assert found(ask(high, high, 11)) == want(high, 11)
    assert ask(999) == []


def test_a_lookup_reads_one_entry(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id * 3 AS doc_id", "concat('word ', id) AS text").coalesce(1)
    store = token_store.write_store(docs, PATH, 2, folder=f"file://{tmp_path}")
    (row,) = spark.read.parquet(store.manifest).collect()
    shard = token_store.Shard(row.file)
    read = []
    real = shard.file
    shard.file = type("Counted", (), {"read_at": lambda self, n, at: read.append(n) or real.read_at(n, at)})()
    ((_, _, size, ids),) = shard.fetch(shard.find(np.array([300, 301], np.int64)), 1000)
    assert len(ids) == size[0] == expected("word 100")[0]
    assert sum(read) <= 2 * token_store.ENTRY.itemsize + 8 + 2 * len(ids)


def test_empty(empty):
    assert token_store.write_store(empty, PATH, 2).documents(empty).collect() == []


def test_long_words_do_not_pile_up():
    from veilwright.llm.wordtable import WordTable
    import pyarrow as pa

    table = WordTable(lambda raw: [len(raw)], most=10_000)
    for k in range(50):
        ids, _ = table.encode_rows(pa.array([f"{k:08d}" + "x" * 1000 + f" {k:08d}" + "y" * 1000]), lambda t: [0])
        assert ids.tolist() == [1008, 1009] and table.long_bytes <= 12_100


def test_rows_are_encoded_in_parts():
    """Rows get the ids they get by themselves, and memory beyond the ids does not grow with the batch."""
    from veilwright.llm.wordtable import WordTable
    import pyarrow as pa

    table = WordTable(lambda word: list(word[:3]))
    whole = lambda text: list(text.encode())
    texts = ["", "one  two", "é" * 40, *(f"word{k % 997} a{k % 89} " * 20 + "end" for k in range(18_000)), "x " * 400_000 + "y", ""]
    ids, at = table.encode_rows(pa.array(texts), whole, 7)
    for k in (*range(9), 9_000, *range(len(texts) - 4, len(texts))):
        own, _ = table.encode_rows(pa.array([texts[k]]), whole, 7)
        assert ids[at[k] : at[k + 1]].tolist() == own.tolist()
    assert len(at) == len(texts) + 1 and at[-1] == len(ids)
    column = pa.array(texts[3:-2])
    tracemalloc.start()
    some, _ = table.encode_rows(column, whole, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * some.nbytes + 30_000_000, (peak, some.nbytes)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    own = np.array(sorted(keys), np.int64)
    index = token_store.PerfectHash.build(own)
    assert sorted(index.rank(own).tolist()) == list(range(len(own)))


def test_perfect_hash_needs_distinct_keys():
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([4, 4]))
