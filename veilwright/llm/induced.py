"""External induced suffix sorting with common prefixes.

Suffixes are told apart by type (S: smaller than the next suffix, L: larger). The leftmost S suffixes
(LMS) are sorted; a scan upward then induces the order of all L suffixes, and a scan downward that
of all S suffixes: each scanned suffix hands its predecessor to the queue of the predecessor's
first byte. Since a scan meets suffixes in order, a priority queue keyed by (byte, time of arrival) gives
them back in order. :class:`Queues` is that queue: one first-in-first-out list a byte, popped and pushed in runs
of up to ``PIECE`` tuples rather than one by one.

A queue's tuple is a suffix and the length of its common prefix with the tuple before it. Two
predecessors with one first byte share one byte more than the suffixes that handed them over, and those share
the least of the values scanned between them: :class:`Least` keeps that for every queue.

Only the first ``depth`` bytes of suffixes are told apart, which is all that matching passages of a
fixed length needs. The LMS suffixes are refined eight bytes at a time, group by group, down to that depth, in runs that fit
memory; runs are merged by their first ``depth`` bytes.

Everything whose size follows the text's (types, LMS suffixes, queues, the result) moves to disk beyond ``limit`` bytes: arrays as mapped
files, lists as files read by pieces. Files have no name, belong to one task and vanish with it; a rerun task makes its own.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

PIECE, FAN = 1 << 16, 16


def room(n: int, kind: type | np.dtype, limit: int) -> np.ndarray:
    """A zeroed array: in memory, or beyond ``limit`` bytes a mapped file without a name."""
    if n * np.dtype(kind).itemsize <= limit:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Spool:
    """Numbers in order, on disk beyond ``limit`` bytes, read back by ranges."""

    def __init__(self, limit: int):
        self.limit, self.held, self.n, self.file = limit, [], 0, None

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.held.append(np.ascontiguousarray(values, np.int64))
        if self.file is not None or 8 * self.n > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for x in self.held:
                self.file.write(x.data)
            self.held = []

    def read(self, low: int = 0, high: int | None = None, piece: int = PIECE) -> Iterator[np.ndarray]:
        high = self.n if high is None else high
        if self.file is None:
            self.held = [np.concatenate(self.held)] if len(self.held) > 1 else self.held
        for k in range(low, high, piece):
            upto = min(k + piece, high)
            if self.file is None:
                yield self.held[0][k:upto]
            else:
                self.file.seek(8 * k)
                yield np.frombuffer(self.file.read(8 * (upto - k)), np.int64)

    def backward(self) -> Iterator[np.ndarray]:
        for high in range(self.n, 0, -PIECE):
            low = max(0, high - PIECE)
            yield next(self.read(low, high))[::-1]


class Queues:
    """Lists by first byte, on disk beyond ``limit`` bytes."""

    def __init__(self, limit: int = 64 << 20):
        self.limit, self.size, self.file = limit, 0, None
        self.held: list[deque] = [deque() for _ in range(256)]

    def push(self, first: np.ndarray, values: np.ndarray) -> None:
        """``values`` to the lists ``first``, which ascend."""
        if not len(values):
            return
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for c, a, b in zip(first[np.concatenate([[0], cut])].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True):
            self.put(c, values[a:b])

    def put(self, c: int, values: np.ndarray) -> None:
        self.held[c].append(values)
        self.size += values.nbytes
        if self.size > self.limit:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        at = self.file.tell()
        for parts in self.held:
            fresh = []
            while parts and isinstance(parts[-1], np.ndarray):  # what came since the last time
                fresh.append(parts.pop())
            for k in range(0, sum(map(len, fresh)), PIECE) if fresh else ():
                if k == 0:
                    whole = np.concatenate(fresh[::-1])
                own = np.ascontiguousarray(whole[k : k + PIECE])
                self.file.write(own.data)
                parts.append((at, len(own)))
                at += own.nbytes
        self.size = 0

    def take(self, c: int) -> np.ndarray:
        """The first tuples of a list, about ``PIECE`` of them; none if it is empty."""
        parts, out, n = self.held[c], [], 0
        while parts and n < PIECE:
            part = parts.popleft()
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), np.int64)
            else:
                self.size -= part.nbytes
            out.append(part)
            n += len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int64)


def loads(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a big-endian number; the text is continued by zeros."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray(shape=(len(text),), dtype=">u8", buffer=padded.data, strides=(1,))


def eight(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same at some places only, also past the end, without a copy of the text."""
    n = len(text)
    whole = np.ndarray(shape=(max(n - 7, 0),), dtype=">u8", buffer=text, strides=(1,))
    if n > 7 and len(at) and int(at.max()) <= n - 8:
        return whole[at].astype(np.uint64)
    out, inside = np.zeros(len(at), np.uint64), at <= n - 8
    out[inside] = whole[at[inside]]
    rest = np.flatnonzero(~inside & (at < n))
    if len(rest):
        first = max(0, n - 7)
        out[rest] = loads(np.concatenate([text[first:], np.zeros(1, np.uint8)]))[at[rest] - first].astype(np.uint64)
    return out


def types(text: np.ndarray, limit: int, step: int = 1 << 20) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the empty suffix is the smallest), worked out from the end, ``step`` bytes at a time."""
    n = len(text)
    out, after = room(n, bool, limit), False
    for high in range(n - 1, 0, -step):
        low = max(0, high - step)
        here, following = text[low:high], text[low + 1 : high + 1]
        turn = np.where(here != following, np.arange(high - low), high - low)
        turn = np.minimum.accumulate(turn[::-1])[::-1]  # the next place where two bytes differ
        rises = np.append(here < following, after)
        out[low:high] = rises[turn]
        after = bool(out[low])
    return out


def _ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    run = values[order]
    out = np.empty(len(values), np.uint64)
    out[order] = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])]).astype(np.uint64)
    return out


class Least:
    """The least common prefix scanned since the last push to each queue."""

    def __init__(self, most: int):
        self.most, self.since = most, np.zeros(256, np.uint8)

    def through(self, common: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scan a run. ``at``: its places that push, to the queues ``first``, in order of these; the least value since each
        queue's last push.
        """
        n, since = len(common), self.since
        if not len(at):
            np.minimum(since, common.min(), out=since)
            return np.zeros(0, np.uint8)
        table, span = [common], 1  # least of 1, 2, 4 ... values from each place
        while 2 * span <= n:
            table.append(np.minimum(table[-1][:-span], table[-1][span:]))
            span *= 2

        def least(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.full(len(low), self.most, np.uint8)
            level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
            for k in np.unique(level[high >= low]).tolist():
                own = np.flatnonzero((level == k) & (high >= low))
                out[own] = np.minimum(table[k][low[own]], table[k][high[own] - (1 << k) + 1])
            return out

        head = np.ones(len(first), bool)
        head[1:] = first[1:] != first[:-1]
        low = np.empty(len(at), np.int64)
        low[1:] = at[:-1] + 1
        low[head] = 0
        value = least(low, at)
        value[head] = np.minimum(value[head], since[first[head]])
        np.minimum(since, common.min(), out=since)
        tail = np.append(np.flatnonzero(head)[1:], len(first)) - 1
        since[first[tail]] = least(at[tail] + 1, np.full(len(tail), n - 1))
        return value


def sort_places(text: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the ``depth`` bytes that start there, and the length each shares with the one before."""
    common = np.zeros(len(places), np.uint8)
    if not len(places):
        return places, common

    def fresh(key: np.ndarray, joined: np.ndarray, step: int, which: np.ndarray) -> np.ndarray:
        """Where a new group begins, of rows ``which``; ``joined``: those that were one group with the row before."""
        differ = np.ones(len(key), bool)
        bits = key[1:] ^ key[:-1]
        differ[1:] = ~joined[1:] | (bits != 0)
        now = np.flatnonzero(joined[1:] & (bits != 0))
        high, low = (bits[now] >> np.uint64(32)).astype(np.float64), (bits[now] & np.uint64(0xFFFFFFFF)).astype(np.float64)
        zeros = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
        common[which[now + 1]] = np.minimum(step + zeros // 8, depth)
        return differ

    key = eight(text, places)
    order = np.argsort(key)
    places, key = places[order], key[order]
    begin = fresh(key, np.ones(len(key), bool), 0, np.arange(len(key)))
    for step in range(8, depth, 8):
        tied = ~begin
        tied[:-1] |= ~begin[1:]
        which = np.flatnonzero(tied)
        if not len(which):
            break
        group = np.cumsum(begin)[which].astype(np.uint64)
        key = eight(text, places[which].astype(np.int64) + step)
        order = np.argsort((group << np.uint64(32)) | _ranks(key))
        places[which], key = places[which][order], key[order]
        joined = np.zeros(len(which), bool)
        joined[1:] = group[1:] == group[:-1]  # sorting stays inside groups
        begin[which] = fresh(key, joined, step, which)
    common[~begin] = depth
    return places, common


def words(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` bytes at each place as big-endian numbers, one row each eight bytes; the text is continued by zeros."""
    out = np.stack([eight(text, places + k) for k in range(0, depth, 8)])
    if depth % 8:
        out[-1] &= np.uint64(2**64 - 2 ** (64 - 8 * (depth % 8)))
    return out


def shared_bytes(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes, in bytes, of columns of :func:`words`."""
    out, open_ = np.zeros(a.shape[1], np.int64), np.ones(a.shape[1], bool)
    for k in range(depth):
        shift = np.uint64(56 - 8 * (k % 8))
        open_ &= (a[k // 8] ^ b[k // 8]) >> shift & np.uint64(255) == 0
        out += open_
    return out


def sorted_lms(text: np.ndarray, small: np.ndarray, depth: int, limit: int) -> tuple[Spool, np.ndarray]:
    """LMS places in order of their first ``depth`` bytes, packed with what each shares with the one before, and how many begin with each byte."""
    most = max(1024, limit // 32)
    runs: list[Spool] = []
    held, n = [], 0
    counts = np.zeros(256, np.int64)

    def flush() -> None:
        nonlocal held, n
        places, common = sort_places(text, np.concatenate(held), depth)
        runs.append(Spool(limit))
        runs[-1].add(places << 8 | common)
        held, n = [], 0

    for low in range(1, len(text), 1 << 20):
        high = min(len(text), low + (1 << 20))
        own = np.flatnonzero(small[low:high] & ~small[low - 1 : high - 1]) + low
        counts += np.bincount(text[own], minlength=256)
        for k in range(0, len(own), most):
            held.append(own[k : k + most])
            n += len(held[-1])
            if n >= most:
                flush()
    if n or not runs:
        held = held or [np.zeros(0, np.int64)]
        flush()
    while len(runs) > 1:
        runs = [merge_runs(text, runs[k : k + FAN], depth, limit) for k in range(0, len(runs), FAN)]
    return runs[0], counts


def merge_runs(text: np.ndarray, runs: list[Spool], depth: int, limit: int) -> Spool:
    """One run of many: what is not above the least of the runs' last keys in memory comes next."""
    step = max(64, min(PIECE, limit // (64 * len(runs))))
    readers = [run.read(piece=step) for run in runs]
    held = [next(r, np.zeros(0, np.int64)) for r in readers]
    out, last = Spool(limit), None
    while any(map(len, held)):
        live = [k for k, x in enumerate(held) if len(x)]
        whole = np.concatenate([held[k] for k in live]) >> 8
        of = np.repeat(np.arange(len(live)), [len(held[k]) for k in live])
        key = words(text, whole, depth)
        order = np.lexsort((of, *key[::-1]))
        ends = np.cumsum([len(held[k]) for k in live]) - 1
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        upto = order[: int(rank[ends].min()) + 1]
        sorted_key = key[:, upto]
        before = np.concatenate([sorted_key[:, :1] if last is None else last, sorted_key[:, :-1]], axis=1)
        common = shared_bytes(before, sorted_key, depth)
        if last is None:
            common[0] = 0
        out.add(whole[upto] << 8 | common)
        last = sorted_key[:, -1:]
        taken = np.bincount(of[upto], minlength=len(live))
        for k, n in zip(live, taken.tolist(), strict=True):
            held[k] = held[k][n:]
            if not len(held[k]):
                held[k] = next(readers[k], np.zeros(0, np.int64))
    return out


def sorted_suffixes(text: np.ndarray, depth: int, limit: int = 64 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of all suffixes by pieces, ordered by at least their first ``depth`` (at most 255) bytes, and the length of the prefix
    (counted up to ``depth``) that each shares with the one before. The text is continued by zeros; whether
    these count as shared is left open. ``text`` may be a mapped file.
    """
    n = len(text)
    if not n:
        return
    small = types(text, limit)
    lms, counts = sorted_lms(text, small, depth, limit)
    heads = np.concatenate([[0], np.cumsum(counts)]).tolist()

    def unpack(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuples >> 8, (tuples & 255).astype(np.uint8)

    def edge(a: int, b: int) -> int:
        """What an L and an S suffix of one first byte share: the shorter of their runs of that byte."""
        c, k = text[a], 1
        while k < depth and a + k < n and b + k < n and text[a + k] == c and text[b + k] == c:
            k += 1
        return k

    def hand_over(places: np.ndarray, common: np.ndarray, kind: bool, least: Least, queues: Queues) -> None:
        """Push the predecessors of type ``kind``; those of the byte scanned come behind what its list holds."""
        at = np.flatnonzero(places > 0)
        at = at[small[places[at] - 1] == kind]
        first = text[places[at] - 1]
        order = np.argsort(first, kind="stable")
        at, first = at[order], first[order]
        queues.push(first, (places[at] - 1) << 8 | (np.minimum(least.through(common, at, first), depth - 1) + np.uint8(1)))

    up, least, done, ends = Queues(limit), Least(depth), Spool(limit), [0]
    up.push(text[n - 1 :], np.array([(n - 1) << 8]))
    for c in range(256):
        last = -1
        while len(now := up.take(c)):
            places, common = unpack(now)
            if last < 0:
                common[0] = 0
            last = int(places[-1])
            done.add(places << 8 | common)
            hand_over(places, common, False, least, up)
        for now in lms.read(heads[c], heads[c + 1]):
            places, common = unpack(now)
            if last >= -1:
                common[0] = edge(last, int(places[0])) if last >= 0 else 0
            last = -2  # only the first of them meets an L suffix
            hand_over(places, common, False, least, up)
        ends.append(done.n)
    down, least, out = Queues(limit), Least(depth), Spool(limit)
    for c in range(255, -1, -1):
        last = -1
        while len(now := down.take(c)):
            places, common = unpack(now)
            if last < 0:
                common[0] = 0
            last = int(places[-1])
            out.add(places << 8 | common)
            hand_over(places, common, True, least, down)
        high, top = ends[c + 1], None
        while high > ends[c]:  # the L suffixes from the largest down: each shares with the one above it what that shares with the one before it
            low = max(ends[c], high - PIECE)
            large, common = unpack(next(done.read(low, high)))
            large, common = large[::-1], common[::-1]
            if top is None:
                top = edge(int(large[0]), last) if last >= 0 else 0
            shifted = np.concatenate([[top], common[:-1]]).astype(np.uint8)
            top, high = int(common[-1]), low
            out.add(large << 8 | shifted)
            hand_over(large, shifted, True, least, down)
    before = 0
    for now in out.backward():
        places, common = unpack(now)
        yield places, np.concatenate([[before], common[:-1]]).astype(np.uint8)
        before = int(common[-1])


def suffix_array(text: np.ndarray, depth: int, limit: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The same in one piece."""
    pieces = list(sorted_suffixes(text, depth, limit))
    return np.concatenate([np.zeros(0, np.int64), *(x for x, _ in pieces)]), np.concatenate([np.zeros(0, np.uint8), *(x for _, x in pieces)])
