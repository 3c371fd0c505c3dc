"""Suffix-array deduplication: cut every passage of ``SPAN`` bytes that an earlier document has too.

1. Rows are gathered into blocks of about ``BLOCK`` bytes, written once to the shared folder.
2. Every run of ``SPAN`` bytes (a window) has an anchor: of the runs of ``GRAM`` bytes in it, the one of
   the least hash. Equal windows have equal anchors. Each block sends its distinct anchor hashes to
   buckets; a bucket answers which of them another document has. Only windows with such an anchor go on.
3. Neighbouring windows with one anchor form a passage, sent to the anchor's bucket: each distinct
   passage once a block, with the least id that has it in the block. Passages with a common anchor (a line
   that many texts have, in ever other surroundings) are sent window by window, by the windows' own hash.
4. A bucket takes the passages that share an anchor with another passage and sorts their suffixes by external induced sorting (:mod:`induced`), which carries
   common prefixes along: neighbours that share ``SPAN`` bytes are one group, of which the least id is
   known. The answer goes back to the blocks as runs of equal ids.
5. Each block marks the bytes of windows whose group has a smaller id than their document, on the text
   as it was, and cuts them.

Buckets hold a bounded share of the text whatever its size: their number follows the bytes read, and no
anchor brings many passages of different surroundings into one. Copies of a passage are merged and stay whole.
Copies are merged inside a block before they move and inside a bucket before they are sorted.

Defined cases: a null text counts as empty; rows that share an id do not cut each other; a null id counts as
the largest; an empty table gives no rows; further columns, whatever their names, come back
unchanged from :func:`cut`. Cutting bytes may split a character: :func:`cut` leaves out the stump.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import _io
from veilwright.llm.induced import loads, room, sorted_suffixes
from veilwright.llm.wordtable import gather, places, text_buffer

SPAN, GRAM, BLOCK, SHARD, STEP = 50, 24, 2_000_000, 1_000_000, 1 << 16
#: An anchor is common if a block has it in ``MANY`` surroundings, or ``COMMON`` blocks have it in more than ``KINDS``.
MANY, COMMON, KINDS = 64, 1000, 8
LAST = 2**63 - 1
_SEEDS = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
_F1 = 0x9E3779B97F4A7C15


def grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` = 24 bytes at each place that has so many."""
    h, span, factor = _SEEDS[buf], 1, _F1
    while span < 16:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor % 2**64
        span *= 2
        if span == 8:
            eight, by_eight = h, factor
    h = h[: len(buf) - GRAM + 1] * np.uint64(by_eight) + eight[16 : len(buf) - GRAM + 17]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one row; the first window of each passage, and its anchor's hash.

    A passage is a run of neighbouring windows with one anchor.
    """
    n = len(buf)
    width = SPAN - GRAM + 1
    kind = np.int32 if n < 2**31 else np.int64
    inside = np.ones(n + 1, bool)  # windows that reach past the end of their row
    for b in offsets[1:].tolist():
        inside[max(0, b - SPAN + 1) : b] = False
    starts, firsts, hashes = [np.zeros(0, kind)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    last, before, total = -1, -1, 0
    for low in range(0, max(0, n - SPAN + 1), STEP):
        piece = buf[low : low + STEP + SPAN - 1]
        h = grams(piece)
        least, span = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        at = np.flatnonzero(inside[low : low + len(least)])
        if not len(at):
            continue
        place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turn = np.ones(len(at), bool)
        turn[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        turn[0] = place[0] + low != last or at[0] + low != before + 1
        head = np.flatnonzero(turn)
        starts.append((at + low).astype(kind))
        firsts.append(head + total)
        hashes.append(h[place[head]])
        last, before, total = int(place[-1]) + low, int(at[-1]) + low, total + len(at)
    return np.concatenate(starts), np.concatenate(firsts), np.concatenate(hashes)


def by_sub(h: np.ndarray, subs: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of an anchor hash, and what tells it from others there."""
    return (h % np.uint64(subs)).astype(np.int64), ((h // np.uint64(subs)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@dataclass(frozen=True)
class Sent:
    """``live``: runs of windows with a shared anchor; ``run``: the distinct passage of each; ``count``: windows by passage;
    ``units``: what is sent (bucket, windows, least id), by bytes; ``parts``: the units of passage after passage.
    """

    live: np.ndarray
    run: np.ndarray
    count: np.ndarray
    units: dict[bytes, list[int]]
    parts: np.ndarray


class Block:
    """Rows held together: their Arrow table, the texts' bytes, offsets and ids."""

    def __init__(self, payload: bytes):
        self.table = pa.ipc.open_stream(payload).read_all()
        self.buf, self.offsets = text_buffer(self.table.column("__text"))
        self.ids = np.asarray(self.table.column("__key").combine_chunks().fill_null(LAST), dtype=np.int64)

    def windows(self, subs: int):
        """The windows, and by passage (neighbouring windows with one anchor in one row): first window, windows, row, anchor."""
        self.start, self.first, h = anchors(self.buf, self.offsets)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.row = np.searchsorted(self.offsets, self.start[self.first], "right") - 1
        sub, mark = by_sub(h, subs)
        self.joint = (sub.astype(np.uint64) << np.uint64(32)) | mark
        return self

    def anchors(self) -> np.ndarray:
        """Distinct anchors: bucket and mark in one number."""
        return np.unique(self.joint)

    def surroundings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, whether several ids have them, whether in many surroundings, and a byte that tells these apart.

        A passage's first and last bytes stand for its surroundings.
        """
        if not len(self.joint):
            return self.joint, np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.uint8)
        word, begin = loads(self.buf), self.start[self.first].astype(np.int64)
        ends = word[begin].astype(np.uint64) * np.uint64(_F1) ^ word[begin + self.count + SPAN - 9].astype(np.uint64)
        ends = (ends ^ (ends >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.lexsort((ends, self.joint))
        joint, ends, ids = self.joint[order], ends[order], self.ids[self.row[order]]
        new = np.ones(len(joint), bool)
        new[1:] = joint[1:] != joint[:-1]
        head = np.flatnonzero(new)
        other = new.copy()
        other[1:] |= ends[1:] != ends[:-1]
        kinds = np.add.reduceat(other.astype(np.int64), head)
        several = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
        return joint[head], several, kinds >= MANY, (ends[head] >> np.uint64(56)).astype(np.uint8)

    def passages(self, shared: np.ndarray, common: np.ndarray, subs: int) -> Sent:
        """What is sent of passages with a shared anchor. ``shared``, ``common``: by distinct anchor."""
        numbers: dict[bytes, int] = {}
        about: list[list[int]] = []
        anchor = np.searchsorted(self.known, self.joint)
        live = np.flatnonzero(shared[anchor]) if len(self.known) else np.zeros(0, np.int64)
        run = np.empty(len(live), np.int64)
        raw, begin, ids = self.buf.tobytes(), self.start[self.first], self.ids[self.row]
        often = common[anchor[live]]
        subs_of = (self.joint >> np.uint64(32)).astype(np.int64)
        for k, (a, n, one, sub, split) in enumerate(zip(begin[live].tolist(), self.count[live].tolist(), ids[live].tolist(), subs_of[live].tolist(), often.tolist(), strict=True)):
            body = raw[a : a + n + SPAN - 1]
            j = numbers.get(body)
            if j is None:
                j = numbers[body] = len(about)
                about.append([sub, n, one, split])
            elif one < about[j][2]:
                about[j][2] = one
            run[k] = j
        bodies, split = list(numbers), np.array([x[3] for x in about], bool)
        units = {bodies[j]: about[j][:3] for j in np.flatnonzero(~split).tolist()}  # what is sent: bucket, windows, least id
        pieces = np.where(split, [x[1] for x in about], 1)
        parts = np.empty(int(pieces.sum()), np.int64)
        place = np.cumsum(pieces) - pieces
        parts[place[~split]] = np.arange(len(units))
        number: dict[bytes, int] = {}
        for j in np.flatnonzero(split).tolist():
            body, one = bodies[j], about[j][2]
            for w in range(about[j][1]):
                piece = body[w : w + SPAN]
                unit = units.get(piece)
                if unit is None:
                    number[piece] = len(units)
                    unit = units[piece] = [xxhash.xxh3_64_intdigest(piece) % subs, 1, one]
                elif one < unit[2]:
                    unit[2] = one
                parts[place[j] + w] = number[piece]
        return Sent(live, run, np.array([x[1] for x in about], np.int64), units, parts)


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """block, size, payload: the rows with all their columns, as compressed Arrow streams."""
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"), F.col(f"`{key}`").cast("long").alias("__key"))
    own = f"c{docs.columns.index(text)}"
    named = named.drop(own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                for x in held:
                    out.write_batch(x)
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([(pid << 32) + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "payload"])

        for batch in batches:
            _, offsets = text_buffer(batch.column(batch.schema.get_field_index("__text")))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK - size, "right")) - 1)
                upto = min(upto, batch.num_rows)
                part = batch.slice(at, upto - at)
                held.append(pa.RecordBatch.from_arrays([x.take(pa.array(range(len(x)))) for x in part.columns], schema=part.schema))
                size += int(offsets[upto] - offsets[at])
                at = upto
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return named.mapInArrow(_io.tidy(work), "block long, size long, payload binary")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, list[tuple[int, bytes]]]]:
    """Rows (block, sub, payload) in order of block and sub: the block's payload has sub -1, answers follow."""
    block, payload, answers = None, None, []
    for batch in batches:
        for b, s, p in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if b != block:
                if payload is not None:
                    yield block, Block(payload), answers
                block, payload, answers = b, None, []
            if s < 0:
                payload = p
            else:
                answers.append((s, p))
    if payload is not None:
        yield block, Block(payload), answers


def _by_sub(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows (sub, block, payload) in order of sub: whole buckets, several together up to ``most`` bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = cut = 0  # rows before ``cut`` belong to buckets that have ended
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held and row[0] != held[-1][0]:
                cut = len(held)
                if size >= most:
                    yield held
                    held, size, cut = [], 0, 0
            held.append(row)
            size += len(row[2])
    if held:
        yield held


def _split(subs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs (bucket, from, to) of an ascending array."""
    cut = np.flatnonzero(np.diff(subs)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(subs)], strict=True):
        if b > a:
            yield int(subs[a]), a, b


def _least_by_window(text: np.ndarray, size: np.ndarray, least: np.ndarray, limit: int) -> np.ndarray:
    """By window of passages (one after another in ``text``): the least id of all windows equal to it."""
    text = np.concatenate([text, np.zeros(64, np.uint8)])
    count = size - SPAN + 1
    at = places(np.cumsum(size) - size, count)
    number = room(len(text), np.int64, limit)
    number[at] = np.arange(1, len(at) + 1)
    of = np.repeat(least, count)
    group, best = room(len(at), np.int64, limit), room(len(at), np.int64, limit)
    best[:] = LAST
    suffixes, groups, last = 0, 0, -1  # groups of suffixes; of those, groups with windows; the last of these
    for start, common in sorted_suffixes(text, SPAN, limit):
        own = suffixes + np.cumsum(common < SPAN)
        suffixes = int(own[-1])
        window = number[start] - 1
        live = window >= 0
        window, own = window[live], own[live]
        if not len(window):
            continue
        new = np.append(own[0] != last, own[1:] != own[:-1])
        which = groups - 1 + np.cumsum(new)
        head = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        best[which[head]] = np.minimum(best[which[head]], np.minimum.reduceat(of[window], head))
        group[window] = which
        groups, last = int(which[-1]) + 1, int(own[-1])
    return best[group]


def _groups(rows: list[tuple[int, int, bytes]], limit: int) -> Iterator[tuple[int, int, bytes]]:
    """(block, sub, answer) for passages of some whole buckets."""
    bodies: dict[bytes, int] = {}
    least: list[int] = []
    members = []
    unpack = zstandard.ZstdDecompressor().decompress
    for _, _, packed in rows:
        raw = unpack(packed)
        n = int.from_bytes(raw[:4], "little")
        size = np.frombuffer(raw, "<u2", n, 4).astype(np.int64)
        ids = np.frombuffer(raw, "<i8", n, 4 + 2 * n)
        ends = 4 + 10 * n + np.cumsum(size)
        own = np.empty(n, np.int64)
        for k, (a, b, one) in enumerate(zip((ends - size).tolist(), ends.tolist(), ids.tolist(), strict=True)):
            body = raw[a:b]
            j = bodies.get(body)
            if j is None:
                j = bodies[body] = len(least)
                least.append(one)
            elif one < least[j]:
                least[j] = one
            own[k] = j
        members.append(own)
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    count, least_of = size - SPAN + 1, np.array(least, np.int64)
    first = np.cumsum(count) - count
    found = np.repeat(least_of, count)
    text = np.frombuffer(b"".join(bodies), np.uint8)
    # equal windows have equal anchors: a passage whose anchor no other passage has meets none of its windows elsewhere
    marks = anchors(text, np.concatenate([[0], np.cumsum(size)]))[2]
    if len(marks) != len(size):
        raise ValueError("a passage has windows of several anchors")
    _, which, times = np.unique(marks, return_inverse=True, return_counts=True)
    met = np.flatnonzero(times[which] > 1)
    if len(met):
        found[places(first[met], count[met])] = _least_by_window(gather(text, (np.cumsum(size) - size)[met], size[met]), size[met], least_of[met], limit)
    for (sub, block, _), own in zip(rows, members, strict=True):
        mins = gather(found, first[own], count[own])
        turn = np.flatnonzero(np.concatenate([[True], mins[1:] != mins[:-1]])) if len(mins) else np.zeros(0, np.int64)
        yield block, sub, len(turn).to_bytes(4, "little") + np.diff(np.append(turn, len(mins))).astype("<u4").tobytes() + mins[turn].astype("<i8").tobytes()


def _bits(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), count=n).astype(bool)


def _triples(rows: Iterator[tuple[int, int, bytes]], names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        a, b, c = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], list(names))

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8_000_000 or len(held) >= 20_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _marked(docs: DataFrame, key: str, text: str, finish: Callable[[Block, np.ndarray], pa.RecordBatch], schema: str, limit: int) -> DataFrame:
    """``finish`` gets each block and which of its bytes are to go."""
    blocks = _io.stash(_blocks(docs, key, text), "blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    subs = max(64, total // BLOCK)  # as many buckets as blocks
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (4 * BLOCK))  # a partition has four blocks or buckets, whatever the setting

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    known, several, many, tag = Block(payload).windows(subs).surroundings()
                    for sub, a, b in _split((known >> np.uint64(32)).astype(np.int64)):
                        yield sub, block, (known[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + tag[a:b].tobytes() + np.packbits(several[a:b]).tobytes() + np.packbits(many[a:b]).tobytes()

        return _triples(rows(), ("sub", "block", "payload"))

    def find_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for held in _by_sub(batches, 1):
                sizes = [(8 * len(p)) // 42 for _, _, p in held]  # n marks of 4 bytes, n bytes, and twice n bits
                marks = np.concatenate([np.frombuffer(p, "<u4", n) for (_, _, p), n in zip(held, sizes, strict=True)])
                tags = np.concatenate([np.frombuffer(p, np.uint8, n, 4 * n) for (_, _, p), n in zip(held, sizes, strict=True)])
                several, many = (np.concatenate([_bits(p, 5 * n + k * ((n + 7) // 8), n) for (_, _, p), n in zip(held, sizes, strict=True)]) for k in (0, 1))
                _, back, times = np.unique(marks, return_inverse=True, return_counts=True)
                shared, common = times > 1, np.zeros(len(times), bool)
                often = np.flatnonzero(times[back] >= COMMON)
                which, kinds = np.unique(np.unique(back[often] * 256 + tags[often]) // 256, return_counts=True)
                common[which] = kinds > KINDS
                shared[back[several]] = True
                common[back[many]] = True
                shared, common = shared[back], common[back]
                at = 0
                for (sub, block, _), n in zip(held, sizes, strict=True):
                    yield block, sub, np.packbits(shared[at : at + n]).tobytes() + np.packbits(common[at : at + n]).tobytes()
                    at += n

        return _triples(rows(), ("block", "sub", "payload"))

    def sent_of(block: Block, answers: list[tuple[int, bytes]]) -> Sent:
        block.windows(subs)
        block.known = block.anchors()
        own = {sub: (a, b) for sub, a, b in _split((block.known >> np.uint64(32)).astype(np.int64))}
        shared, common = np.zeros(len(block.known), bool), np.zeros(len(block.known), bool)
        for sub, raw in answers:
            a, b = own[sub]
            shared[a:b], common[a:b] = _bits(raw, 0, b - a), _bits(raw, len(raw) // 2, b - a)
        return block.passages(shared, common, subs)

    def send_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def rows() -> Iterator[tuple[int, int, bytes]]:
            for number, block, answers in _by_block(batches):
                held: dict[int, list[tuple[bytes, int]]] = {}
                for body, (sub, _, one) in sent_of(block, answers).units.items():
                    held.setdefault(sub, []).append((body, one))
                for sub, own in held.items():
                    yield sub, number, squeeze(len(own).to_bytes(4, "little") + np.array([len(x) for x, _ in own], "<u2").tobytes() + np.array([y for _, y in own], "<i8").tobytes() + b"".join(x for x, _ in own))

        return _triples(rows(), ("sub", "block", "payload"))

    def find_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _triples((x for held in _by_sub(batches, SHARD) for x in _groups(held, limit)), ("block", "sub", "payload"))

    def finish_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, answers in _by_block(batches):
            shared_raw = [(s - subs, p) for s, p in answers if s >= subs]
            sent = sent_of(block, [(s, p) for s, p in answers if s < subs])
            bucket, count = (np.array([x[k] for x in sent.units.values()], np.int64) for k in (0, 1))
            least = np.full(int(count.sum()), LAST, np.int64)
            first = np.cumsum(count) - count
            by_bucket = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by_bucket], np.array([[x, x + 1] for x, _ in shared_raw], np.int64).reshape(-1, 2))
            mins = []
            for _, raw in shared_raw:
                n = int.from_bytes(raw[:4], "little")
                mins.append(np.repeat(np.frombuffer(raw, "<i8", n, 4 + 4 * n), np.frombuffer(raw, "<u4", n, 4)))
            if mins:
                own = by_bucket[places(edges[:, 0], edges[:, 1] - edges[:, 0])]
                least[places(first[own], count[own])] = np.concatenate(mins)
            least = gather(least, first[sent.parts], count[sent.parts])  # passage after passage
            begin = np.cumsum(sent.count) - sent.count
            got = gather(least, begin[sent.run], sent.count[sent.run])
            where = places(block.first[sent.live], block.count[sent.live])
            hit = block.start[where[got < np.repeat(block.ids[block.row[sent.live]], block.count[sent.live])]]
            edge = np.zeros(len(block.buf) + 1, np.int32)  # a window is hit once at most
            edge[hit] += 1
            edge[hit + SPAN] -= 1
            yield finish(block, np.cumsum(edge[:-1]) > 0)

    triple, back = "sub long, block long, payload binary", "block long, sub long, payload binary"
    bucketed = lambda df: df.repartition(parts, "sub").sortWithinPartitions("sub", "block")
    gathered = lambda df: df.repartition(parts, "block").sortWithinPartitions("block", "sub")
    masks = _io.stash(bucketed(blocks.select("block", "payload").mapInArrow(_io.tidy(send_anchors), triple)).mapInArrow(_io.tidy(find_shared), back), "masks")
    own = blocks.select("block", F.lit(-1).cast("long").alias("sub"), "payload")
    sent = gathered(own.unionByName(masks)).mapInArrow(_io.tidy(send_passages), triple)
    answers = _io.stash(bucketed(sent).mapInArrow(_io.tidy(find_groups), back), "answers")
    all_rows = own.unionByName(masks).unionByName(answers.withColumn("sub", F.col("sub") + F.lit(subs)))
    return gathered(all_rows).mapInArrow(_io.tidy(finish_blocks), schema)


def _bits_of(block: Block, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: bytes, removed bytes, removed runs."""
    sizes = np.diff(block.offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    removed = np.bincount(row[gone], minlength=len(sizes))
    begin = gone.copy()
    begin[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
    return sizes, removed, np.bincount(row[begin], minlength=len(sizes))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 64 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""

    def finish(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        sizes, removed, spans = _bits_of(block, gone)
        kept = [hashlib.sha256(block.buf[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
        ids = pa.array(block.ids, mask=np.asarray(block.table.column("__key").combine_chunks().is_null()))
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _marked(docs, key, text, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", limit)


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 64 << 20) -> DataFrame:
    """The rows with all their columns, the repeated passages cut from the text; rows of which nothing is left go.

    A text that was empty before stays as it was (null becomes empty).
    """
    columns, at = docs.columns, docs.columns.index(text)
    plain = [c for c in range(len(columns)) if c != at]

    def finish(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        sizes, removed, _ = _bits_of(block, gone)
        keep = pa.array((sizes == 0) | (removed < sizes))
        raw = block.buf
        texts = [raw[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
        arrays: list = [None] * len(columns)
        for k in plain:
            arrays[k] = block.table.column(f"c{k}").combine_chunks()
        arrays[at] = pa.array(texts, pa.string())
        out = pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(columns))])
        return out.filter(keep)

    kinds = ", ".join(f"c{k} {'string' if k == at else docs.schema[k].dataType.simpleString()}" for k in range(len(columns)))
    return _marked(docs, key, text, finish, kinds, limit).toDF(*columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(_io.read(spark, sf_dir, "documents"))


#: A self-join of all windows of 50 bytes, as hexadecimal text; a text is cut into pieces first, so that windows are not counted from its start.
OP5_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT *, length(h) // 2 AS n FROM d),
p AS (SELECT r, doc_id, n, k, h[400 * k + 1:400 * k + 498] AS piece FROM (SELECT *, unnest(range(0, (n + 150) // 200)) AS k FROM s)),
w AS (SELECT r, doc_id, 200 * k + j AS a, piece[2 * j + 1:2 * j + 100] AS x FROM (SELECT *, unnest(range(0, least(200, length(piece) // 2 - 49))) AS j FROM p WHERE length(piece) >= 100)),
f AS (SELECT x, min(coalesce(doc_id, 9223372036854775807)) AS first FROM w GROUP BY x),
hit AS (SELECT r, a FROM w JOIN f USING (x) WHERE first < coalesce(doc_id, 9223372036854775807)),
mark AS (SELECT r, a, CASE WHEN a <= lag(a) OVER (PARTITION BY r ORDER BY a) + 50 THEN 0 ELSE 1 END AS new FROM hit),
isle AS (SELECT r, min(a) AS b, max(a) + 50 AS e FROM (SELECT r, a, sum(new) OVER (PARTITION BY r ORDER BY a) AS k FROM mark) GROUP BY r, k),
gap AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS since FROM isle),
gone AS (SELECT r, sum(e - b) AS removed, count(*) AS spans, max(e) AS last, string_agg(h[2 * since + 1:2 * b], '' ORDER BY b) AS kept FROM gap JOIN s USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || h[2 * coalesce(last, 0) + 1:])) AS kept_sha256 FROM s LEFT JOIN gone USING (r)"""
