import hashlib
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import order, pairs
from veilwright.llm import bpe
from veilwright.llm.queries import tokenizer_file
from veilwright.llm.tokenizer import load

PATH = tokenizer_file("byte_bpe_50k.json")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def expected(text: str):
    ids = load(PATH).encode(text, add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(load(PATH).decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("which", ["edge", "smoke_docs", "empty"])
def test_digests_equal_library(which, request):
    docs = request.getfixturevalue(which)
    got = order((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH).collect())
    assert got == order((k, *expected(t)) for k, t in pairs(docs))


def test_round_trip(edge):
    got = bpe.decode(bpe.encode(edge, PATH), PATH)
    assert order((r.doc_id, r.text) for r in got.collect()) == order(pairs(edge))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeioubcdt hsr'\n.,0123", max_size=80)))
def test_automaton_equals_library(text):
    assert bpe.codec(PATH).encode(text) == load(PATH).encode(text, add_special_tokens=False).ids


def test_special_tokens():
    text = "a<|endoftext|> b<|endoftext|><|endoftext|>c <|endoftext"
    assert bpe.codec(PATH).encode(text) == load(PATH).encode(text, add_special_tokens=False).ids


def naive(merges):
    """The automaton as a set of arcs (state, token, state), by gadgets on single arcs, without unreachable states."""
    arcs, states = {(0, c, 0) for c in "abc"}, 1
    for u, v in merges:
        for q in sorted({y for _, t, y in arcs if t == u}):
            into = {(x, t, y) for x, t, y in arcs if t == u and y == q}
            out = {(t, y) for x, t, y in arcs if x == q}
            ends = [y for t, y in out if t == v]
            if not ends:
                continue
            copy, states = states, states + 1
            arcs = (arcs - into) | {(copy, t, y) for t, y in out if t != v}
            # a self loop with u is led to the copy as well, from the copy too
            arcs = {(x, t, copy if t == u and y == q else y) for x, t, y in arcs}
            sources = {x for x, _, _ in into} | ({copy} if u != v and any(x == q for x, _, _ in into) else set())
            arcs |= {(x, u, copy) for x in sources}
            arcs |= {(x, u + v, ends[0]) for x in sources}
    reached, todo = {0}, [0]
    while todo:
        here = todo.pop()
        for x, _, y in arcs:
            if x == here and y not in reached:
                reached.add(y)
                todo.append(y)
    return {(x, t, y) for x, t, y in arcs if x in reached}


def merged(text, merges):
    """Byte-pair encoding as it is defined: the merge of least rank, everywhere, from the left."""
    parts = list(text)
    for u, v in merges:
        k = 0
        while k + 1 < len(parts):
            if parts[k] == u and parts[k + 1] == v:
                parts[k : k + 2] = [u + v]
            k += 1
    return parts


@pytest.mark.parametrize("merges", [[("a", "b")], [("a", "a")], [("a", "a"), ("aa", "a"), ("aa", "aa")], [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc"), ("abc", "a")], [("b", "c"), ("a", "bc"), ("c", "a"), ("ca", "b"), ("a", "a"), ("aa", "b")]])
def test_automaton_equals_naive_construction(merges):
    words = ["a", "b", "c", *dict.fromkeys(u + v for u, v in merges)]
    number = {w: k for k, w in enumerate(words)}
    tables = bpe.compile_merges([0, 1, 2], [(number[u], number[v], number[u + v]) for u, v in merges])
    bits = np.unpackbits(tables.arcs, axis=1, bitorder="little")
    got = {(x, words[tables.token[k]], int(tables.target[k])) for k in range(len(bits)) for x in np.flatnonzero(bits[k]).tolist()}
    want = naive(merges)
    assert len(got) == len(want) and len({x for x, _, _ in got}) == len({x for x, _, _ in want})
    automaton = bpe.Automaton([w.encode() for w in words], tables)
    for n in range(1, 8):
        for letters in itertools.product("abc", repeat=n):
            text = "".join(letters)
            assert [words[t] for t in automaton.encode(text.encode())] == merged(text, merges), text


def test_a_long_run_without_white_space():
    text = "=" * 3000 + "ab" * 3000 + "a" * 3001
    assert bpe.codec(PATH).automaton.encode(b"a" * 3001) == load(PATH).encode("a" * 3001, add_special_tokens=False).ids
    assert bpe.codec(PATH).encode(text) == load(PATH).encode(text, add_special_tokens=False).ids
