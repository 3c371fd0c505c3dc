"""Byte-pair encoding as a deterministic automaton over tokens, and decoding by its arc labels.

The automaton starts as one state with an arc for each byte. A merge ``u v -> w`` of the vocabulary,
taken in order of priority, is applied as a gadget: arcs ``u`` are led to a copy of their target
that has no arc ``v`` (the target itself, if nothing else leads there), and every state with an arc ``u`` gets an arc ``w`` to where
``u v`` used to end. After the last merge the automaton accepts, for every byte string, exactly one token sequence:
the one that byte-pair encoding gives.

All arcs of one label end in one state, so the compiled automaton is two tables: the target of each label, and a bit for each
label and state. The driver compiles them once and sends them to the executors, packed; their size is labels times states
bits, whatever the data (92 MB unpacked for a vocabulary of 50 thousand), and vocabularies beyond ``MOST_BYTES`` are refused.

A word is encoded left to right by table steps: a second automaton, over bytes, tells the labels that end at a place, longest
first; the first of them that has an arc from the state in which the rest of the prefix ends is the one. The work is the word's
length times the labels that end at a place, for runs without white space of any length too.

Defined cases: a null or empty text has no ids and decodes to the empty text; strings of special
tokens in a text become their ids; rows that share an id are encoded each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from array import array
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from veilwright.llm import _io
from veilwright.llm.tokenizer import BYTE_TO_CHAR, CHAR_TO_BYTE
from veilwright.llm.wordtable import WordTable, gather, text_slices

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_BYTES = 1 << 30


@dataclass(frozen=True)
class Tables:
    """By label: its token and target; ``arcs``: by label, a bit for each state that has an arc of it."""

    token: np.ndarray
    target: np.ndarray
    arcs: np.ndarray

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((self.token, self.target, self.arcs), protocol=5))

    @staticmethod
    def unpack(raw: bytes) -> Tables:
        return Tables(*pickle.loads(zstandard.ZstdDecompressor().decompress(raw)))


def compile_merges(alphabet: Sequence[int], merges: Sequence[tuple[int, int, int]]) -> Tables:
    """``alphabet``: tokens of single bytes; ``merges``: (left, right, made) tokens by priority.

    A label is a byte or a merge that takes effect: a token that several merges make has several labels.
    """
    users = {0: len(alphabet) + 1}  # state -> labels that lead there; the start counts once more
    token, target = [*alphabet], [0] * len(alphabet)
    labels: dict[int, list[int]] = {t: [k] for k, t in enumerate(alphabet)}
    states, width = 1, 64
    arcs = np.zeros((len(alphabet) + len(merges), width), np.uint8)
    arcs[: len(alphabet), 0] = 1
    for u, v, w in merges:
        for left in list(labels.get(u, ())):
            for right in list(labels.get(v, ())):
                at, end, n = target[left], target[right], len(token)
                if not arcs[right, at >> 3] >> (at & 7) & 1:
                    continue
                if n == len(arcs):
                    arcs = np.concatenate([arcs, np.zeros((1024, width), np.uint8)])
                own = at
                if users[at] > 1 or at == end:
                    own, states = states, states + 1
                    if own >> 3 == width:
                        width = min(2 * width, len(merges) // 8 + 1)
                        if len(arcs) * width > MOST_BYTES:
                            raise ValueError("the automaton of this vocabulary is too large")
                        wide = np.zeros((len(arcs), width), np.uint8)
                        wide[:, : arcs.shape[1]] = arcs
                        arcs = wide
                    arcs[:n, own >> 3] |= (arcs[:n, at >> 3] >> (at & 7) & 1) << (own & 7)
                    users[at] -= 1
                    users[own] = 1
                    target[left] = own
                arcs[right, own >> 3] &= 255 ^ (1 << (own & 7))
                arcs[n] = arcs[left]
                token.append(w)
                target.append(end)
                users[end] += 1
                labels.setdefault(w, []).append(n)
    return Tables(np.array(token, np.int32), np.array(target, np.int32), np.ascontiguousarray(arcs[: len(token), : (states + 7) // 8]))


class Automaton:
    """``labels``: the bytes of each token."""

    def __init__(self, labels: list[bytes], tables: Tables):
        self.labels = labels
        self.token, self.target = tables.token.tolist(), tables.target.tolist()
        self.width, self.bits = tables.arcs.shape[1], memoryview(tables.arcs.reshape(-1))
        self.size = [len(labels[t]) for t in self.token]
        self._spell()

    def _spell(self) -> None:
        """The automaton over bytes: ``go`` (node and byte to node), ``ends`` (by node, the longest label that ends there), ``shorter`` (by label, the next)."""
        go: dict[int, int] = {}
        nodes, here = 1, {}
        for label, t in enumerate(self.token):
            node = 0
            for b in self.labels[t]:
                key = node << 8 | b
                if (to := go.get(key)) is None:
                    go[key] = to = nodes
                    nodes += 1
                node = to
            here.setdefault(node, []).append(label)
        fail, ends, self.shorter = [0] * nodes, [-1] * nodes, [-1] * len(self.token)
        below: list[list[tuple[int, int]]] = [[] for _ in range(nodes)]
        for key, to in go.items():
            below[key >> 8].append((key & 255, to))
        todo = deque([0])
        while todo:
            node = todo.popleft()
            last = ends[fail[node]] if node else -1
            for label in here.get(node, ()):
                self.shorter[label] = last
                last = label
            ends[node] = last
            for b, to in below[node]:
                f = fail[node]
                while f and (f << 8 | b) not in go:
                    f = fail[f]
                fail[to] = go.get(f << 8 | b, 0) if node else 0
                todo.append(to)
        self.go, self.fail, self.ends, self.kept = go, fail, ends, len(go)

    def _step(self, node: int, b: int) -> int:
        """A step that the table lacks, which is added."""
        f = node
        while f and (f << 8 | b) not in self.go:
            f = self.fail[f]
        to = self.go.get(f << 8 | b, 0)
        if len(self.go) < self.kept + 500_000:
            self.go[node << 8 | b] = to
        return to

    def encode(self, word: bytes) -> list[int]:
        n = len(word)
        state, arc = array("i", bytes(4 * (n + 1))), array("i", bytes(4 * (n + 1)))
        go, ends, shorter, size, target, bits, width = self.go.get, self.ends, self.shorter, self.size, self.target, self.bits, self.width
        node = 0
        for end, b in enumerate(word, 1):
            to = go(node << 8 | b)
            node = self._step(node, b) if to is None else to
            label = ends[node]
            while True:
                s = state[end - size[label]]
                if bits[label * width + (s >> 3)] >> (s & 7) & 1:
                    break
                label = shorter[label]  # one of them has an arc: every prefix has a token sequence
            state[end], arc[end] = target[label], label
        out = []
        while n:
            out.append(self.token[arc[n]])
            n -= size[arc[n]]
        return out[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, one after another."""
        return b"".join(map(self.labels.__getitem__, ids.tolist()))


class Codec:
    """A byte-level vocabulary file and its automaton, compiled here unless ``tables`` brings it."""

    def __init__(self, path: str, tables: Tables | None = None):
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        vocab = about["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in about["added_tokens"]}
        labels = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for word, k in vocab.items():
            labels[k] = bytes(CHAR_TO_BYTE.get(c, 63) for c in word) if word not in self.special else word.encode()
        for word, k in self.special.items():
            labels[k] = word.encode()
        pairs = [x.split(" ") if isinstance(x, str) else x for x in about["model"]["merges"]]
        self.tables = tables or compile_merges([vocab[c] for c in BYTE_TO_CHAR], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.automaton = Automaton(labels, self.tables)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, list[int]] = {}
        self.table = WordTable(lambda raw: self.encode(raw.decode()), "<u2" if len(labels) <= 65536 else "<u4")

    def encode(self, text: str) -> list[int]:
        """Ids of any text: special tokens first, then words, then the automaton."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for word in self.split.findall(part):
                ids = self.words.get(word)
                if ids is None:
                    if len(self.words) > 100_000:
                        self.words.clear()
                    ids = self.words[word] = self.automaton.encode(word.encode())
                out += ids
        return out

    def encode_rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.table.encode_rows(column, self.encode)

    def decode(self, ids: np.ndarray) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str, sent: Broadcast | None = None) -> Codec:
    """The compiled vocabulary of this process."""
    if path not in _codecs:
        if len(_codecs) == 2:
            _codecs.clear()
        _codecs[path] = Codec(path, Tables.unpack(sent.value) if sent else None)
    return _codecs[path]


def send(spark: SparkSession, path: str) -> Broadcast:
    """The tables for executors: packed, a few MB for a vocabulary of 50 thousand."""
    return spark.sparkContext.broadcast(codec(path).tables.pack())


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for every row."""
    sent = send(docs.sparkSession, tokenizer_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            ids, at = codec(tokenizer_path, sent).encode_rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return _io.text_rows(docs, key, text).mapInArrow(_io.tidy(work), "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text for every row of ids; null ids give the empty text."""
    sent = send(rows.sparkSession, tokenizer_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(tokenizer_path, sent).decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(key, ids).mapInArrow(_io.tidy(work), "doc_id long, text string")


@lru_cache(maxsize=2)
def _decimals(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = [f"{k}," for k in range(len(codec(path).automaton.labels))]
    size = np.array([len(x) for x in words], np.int64)
    return np.frombuffer("".join(words).encode(), np.uint8), np.cumsum(size) - size, size


def digests(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without moving ids between processes."""
    sent = send(docs.sparkSession, tokenizer_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            coder = codec(tokenizer_path, sent)
            ids, at = coder.encode_rows(batch.column(1))
            pool, begin, size = _decimals(tokenizer_path)
            shas, texts = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = ids[a:b]
                shas.append(hashlib.sha256(gather(pool, begin[own], size[own])[:-1].tobytes()).hexdigest())
                raw = coder.automaton.decode(own)
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    raw = raw.decode("utf-8", "replace").encode()
                texts.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _io.text_rows(docs, key, text).mapInArrow(_io.tidy(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4(tokenizer_path: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: digests(_io.read(spark, sf_dir, "documents"), tokenizer_path)
