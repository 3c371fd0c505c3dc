"""Order-preserving packing of documents into windows of bounded length by dynamic programming.

Documents are dealt out by ranges of their id and keep their order. Within a segment the possible
cuts are document ends (free), sentence ends (a small penalty) and, where no such end comes for
``STRIDE`` tokens, places inside a sentence (a larger penalty). A window of ``size`` tokens or of a power of two has no
padding, any other is padded to ``size``; each window costs ``WINDOW_COST``, so that of equal plans the one with fewer
windows is taken. With ``best[j]`` the least cost of all windows up to cut ``j``::

    best[j] = penalty[j] + min of
        best[i] + size - (at[j] - at[i])    over cuts i with 0 < at[j] - at[i] <= size
        best[i]                             where at[j] - at[i] needs no padding
        best[i] + INNER_COST                where at[j] - at[i] is the sum of two such lengths, the first of size / 2 or more

The padding is linear in ``at[i]``, so a monotone queue of ``best[i] + at[i]`` gives the first minimum in
constant amortised time; the others are a fixed number of lengths, looked up by place. The last line cuts at any token,
wherever such a cut saves padding. The end of a segment is cut into powers of two where that costs less than its padding.

A segment and a task end with a window; where the next document would have shared it, it is padded or cut as just told.

Defined cases: a null or empty text is its end token alone; a null id sorts first; rows that share
an id stay side by side; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.llm import _io, tokenizer
from veilwright.llm.wordtable import text_slices

SIZE, STRIDE, SENTENCE_COST, INNER_COST, WINDOW_COST = 2048, 256, 4, 48, 1


@lru_cache(maxsize=8)
def exact_lengths(size: int) -> tuple[tuple[int, int], ...]:
    """(length, first window): stretches that one window (first: 0) or two, the first of half of ``size`` or more, fill without padding."""
    free = sorted({size, *(1 << k for k in range(size.bit_length()))})
    out = {a + b: a for a in free if 2 * a >= size for b in free if b <= a}
    return tuple(sorted((out | dict.fromkeys(free, 0)).items()))


class Steps:
    """Places from which a place is reached without padding, by one window or by two. Held as arrays, read as lists ``PART`` places at a time."""

    PART = 4096

    def __init__(self, at: np.ndarray, number: np.ndarray, lengths: Sequence[tuple[int, int]]):
        to, source, first = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int16)]
        for length, begin in lengths:
            j = np.arange(int(np.searchsorted(at, length)), len(at), dtype=np.int32)
            i = number[at[j] - length]
            to.append(j[i >= 0])
            source.append(i[i >= 0])
            first.append(np.full(len(source[-1]), begin, np.int16))
        to, source, first = np.concatenate(to), np.concatenate(source), np.concatenate(first)
        order = np.argsort(to, kind="stable").astype(np.int32)
        self.source, self.first = source[order], first[order]
        self.head = np.searchsorted(to[order], np.arange(len(at) + 1))

    def part(self, k: int) -> tuple[list[int], list[int], list[int]]:
        """For places ``k`` and on: where each one's steps begin in the two lists, from where they come, and the first window's length."""
        head = self.head[k : k + self.PART + 1]
        return (head - head[0]).tolist(), self.source[head[0] : head[-1]].tolist(), self.first[head[0] : head[-1]].tolist()


def plan_cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> np.ndarray:
    """Where windows end, of least total cost. ``at``: possible places, ascending from 0.

    Steps of two windows cost ``INNER_COST`` more, so they are only looked at where the best of the places that they can come
    from leaves them a chance.
    """
    number = np.full(int(at[-1]) + 1, -1, np.int32)
    number[at] = np.arange(len(at), dtype=np.int32)
    one, two = (Steps(at, number, [x for x in exact_lengths(size) if bool(x[1]) == several]) for several in (False, True))
    del number
    places, costs, reach, more = at.tolist(), penalty.tolist(), 2 * size, INNER_COST + 2 * WINDOW_COST
    back, middle, best = np.zeros(len(places), np.int32), np.zeros(len(places), np.int16), [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # value best + at, place, index
    least: deque[tuple[int, int]] = deque([(0, 0)])  # best of the last 2 * size ids, place
    for block in range(0, len(places), Steps.PART):
        head1, source1, _ = one.part(block)
        head2, source2, first2 = two.part(block)
        for j in range(max(1, block), min(block + Steps.PART, len(places))):
            p = places[j]
            low = p - size
            while queue[0][1] < low:
                queue.popleft()
            value, _, i = queue[0]
            value, cut = value + size - p + WINDOW_COST, 0
            k = j - block
            for x in source1[head1[k] : head1[k + 1]]:
                if best[x] + WINDOW_COST < value:
                    value, i = best[x] + WINDOW_COST, x
            low = p - reach
            while least[0][1] < low:
                least.popleft()
            if least[0][0] + more < value:
                for n in range(head2[k], head2[k + 1]):
                    if best[source2[n]] + more < value:
                        value, i, cut = best[source2[n]] + more, source2[n], first2[n]
            back[j], middle[j] = i, cut
            best[j] = value = value + costs[j]
            while least and least[-1][0] >= value:
                least.pop()
            least.append((value, p))
            value += p
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, p, j))
    out, j = [], len(places) - 1
    while j:
        out.append(places[j])
        if middle[j]:
            out.append(places[back[j]] + int(middle[j]))
        j = int(back[j])
    return np.array(out[::-1], np.int64)


def split_tail(ends: np.ndarray, size: int) -> np.ndarray:
    """Cuts the last window into lengths that are powers of two where that costs less than padding it."""
    if not len(ends):
        return ends
    begin = int(ends[-2]) if len(ends) > 1 else 0
    rest = int(ends[-1]) - begin
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    if INNER_COST * (len(powers) - 1) >= size - rest:
        return ends
    return np.concatenate([ends[:-1], begin + np.cumsum(powers)])


def candidates(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and their penalties. ``ends``: offsets behind each document."""
    total = int(ends[-1])
    cost = np.full(total + 1, -1, np.int32)
    cost[np.flatnonzero(sentence[ids]) + 1] = SENTENCE_COST
    cost[ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > STRIDE)
    if len(wide):
        n = (gaps[wide] - 1) // STRIDE
        inner = np.repeat(at[wide], n) + STRIDE * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1)
        cost[inner] = INNER_COST
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


@lru_cache(maxsize=4)
def sentence_ends(path: str) -> np.ndarray:
    """By id: its text ends a sentence or a line."""
    tok = tokenizer.load(path)
    out = np.zeros(tok.get_vocab_size() + 1, bool)
    for word, k in tok.get_vocab().items():
        out[k] = word.endswith((".", "!", "?", tokenizer.BYTE_TO_CHAR[10])) if k < len(out) else False
    return out


def pack_segment(keys: np.ndarray, ids: np.ndarray, at: np.ndarray, sentence: np.ndarray, size: int, first: int) -> tuple[dict[str, np.ndarray], int]:
    """Pieces of one segment, and the next window's number. ``at``: offsets of documents and the end."""
    place, cost = candidates(ids, at[1:], sentence)
    ends = split_tail(plan_cuts(place, cost, size), size)
    edges = np.union1d(at, ends)
    start, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(at, start, "right") - 1
    window = np.searchsorted(ends, start, "right")
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    begin = np.concatenate([[0], ends])[window]
    return {"doc": keys[doc], "start": start - at[doc], "length": length, "ids_crc32": np.array(crc, np.int64), "doc_tokens": np.diff(at)[doc], "window": first + window, "offset": start - begin}, first + len(ends)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SIZE, key: str = "doc_id", text: str = "text", segment_tokens: int = 2_000_000, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A task packs its range of documents in segments of about ``segment_tokens``, which bounds its
    memory; only a segment's last window is padded for want of further text.
    """
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, pid int" + ", ids array<int>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, whole, sentence = tokenizer.word_table(tokenizer_path, True), tokenizer.whole(tokenizer_path), sentence_ends(tokenizer_path)
        pid, window, held, tokens = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal window
            keys, null = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            ids = np.concatenate([x[2] for x in held])
            at = np.concatenate([[0], np.cumsum(np.concatenate([x[3] for x in held]))])
            out, window = pack_segment(np.arange(len(keys)), ids, at, sentence, size, window)
            doc = out.pop("doc")
            arrays = [pa.array(keys[doc], pa.int64(), mask=null[doc]), *(pa.array(x, pa.int64()) for x in out.values()), pa.array(np.full(len(doc), pid, np.int32))]
            if with_ids:
                a = at[doc] + out["start"]
                arrays.append(pa.array([ids[x : x + n] for x, n in zip(a.tolist(), out["length"].tolist(), strict=True)], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in columns.split(", ")])

        for batch in text_slices(batches, 1):
            ids, at = table.encode_rows(batch.column(1), whole, end_id)
            held.append((np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null()), ids, np.diff(at)))
            tokens += len(ids)
            if tokens >= segment_tokens:
                yield flush()
                held, tokens = [], 0
        if held:
            yield flush()

    ordered = _io.text_rows(docs, key, text).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    pieces = _io.stash(ordered.mapInArrow(_io.tidy(work), columns), "pieces")
    counts = pieces.groupBy("pid").agg((F.max("window") + 1).alias("n"))
    past = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = _io.stash(counts.withColumn("base", F.coalesce(F.sum("n").over(past), F.lit(0).cast("long"))).select("pid", "base"), "bases")
    out = pieces.join(base, "pid").withColumn("sequence_id", F.col("base") + F.col("window"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op7(tokenizer_path: str, end_id: int = 1) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: pack(_io.read(spark, sf_dir, "documents"), tokenizer_path, end_id)
