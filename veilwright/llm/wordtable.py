"""Whole-batch tokenization by a hash table of words, in numpy.

Byte-pair encoders cut a text at white space first, so equal words always get equal ids. A
:class:`WordTable` holds the ids of words seen before. A batch of texts is cut into words with a
few passes over its bytes; each word of up to 16 bytes is looked up by its exact bytes (two 64-bit
loads), never by a hash alone. Only unseen words reach the encoder itself.

Texts that a cut at white space could change (white space in runs or at the end, control
characters, characters from U+0250 on) are reported as ``odd`` and encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True
_ODD = np.zeros(256, bool)
_ODD[:32] = True
_ODD[[9, 10, 13]] = False
_ODD[127] = True
_ODD[0xCA:] = True
_MASK = np.array([(1 << (8 * min(n, 8))) - 1 for n in range(17)], dtype=np.uint64)
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def places(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``o .. o + n - 1`` of each pair, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(offsets - before, lengths)


def gather(pool: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices ``pool[o : o + n]`` one after another."""
    return pool[places(offsets, lengths)]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the offsets of its rows (one more than rows)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class WordTable:
    """Ids by word.

    ``encode``: the ids of one word with the white-space byte before it (none at a text's start).
    ``limit``: words held, ``most``: ids and bytes of long words held; the table is emptied beyond them, which costs time only.
    """

    PART = 500_000

    def __init__(self, encode: Callable[[bytes], Sequence[int]], dtype: str = "<u2", limit: int = 1_200_000, keep_white: bool = True, most: int = 16 << 20):
        self.encode, self.dtype, self.limit, self.keep_white, self.most = encode, dtype, limit, keep_white, most
        self._clear()

    def _clear(self) -> None:
        bits = max(10, int(self.limit * 2.5).bit_length())
        self.shift = np.uint64(64 - bits)
        self.wrap = (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.lo, self.hi, self.meta = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint16)
        self.at, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.filled, self.count, self.long, self.long_bytes = np.zeros(1 << 14, self.dtype), 0, 0, {}, 0

    def _add(self, ids: Sequence[int]) -> int:
        k, e = self.count, self.filled + len(ids)
        if e > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(e, len(self.pool)), self.dtype)])
        if k == len(self.at):
            for name in ("lo", "hi", "meta", "at", "n"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.pool[self.filled : e] = ids
        self.at[k], self.n[k] = self.filled, len(ids)
        self.filled, self.count = e, k + 1
        return k

    def _hash(self, lo: np.ndarray, hi: np.ndarray, meta: np.ndarray) -> np.ndarray:
        h = (lo ^ (hi * _K2 + meta.astype(np.uint64) * _K3)) * _K1
        h ^= h >> np.uint64(29)
        return ((h * _K2) >> self.shift).astype(np.int64)

    def _find(self, lo: np.ndarray, hi: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Entries, or -1."""
        at = self._hash(lo, hi, meta)
        out = np.full(len(lo), -1, np.int64)
        left = np.arange(len(lo))
        while len(left):
            e = self.slot[at[left]].astype(np.int64)
            left, e = left[e >= 0], e[e >= 0]
            same = (self.lo[e] == lo[left]) & (self.hi[e] == hi[left]) & (self.meta[e] == meta[left])
            out[left[same]] = e[same]
            left = left[~same]
            at[left] = (at[left] + 1) & self.wrap
        return out

    def words(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, the byte before each (0 at a text's start), odd rows."""
        n, rows = len(buf), len(offsets) - 1
        odd = np.zeros(rows, bool)
        if not n:
            return *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint8), odd
        row_of = lambda at: np.searchsorted(offsets, at, "right") - 1
        white = _WHITE[buf]
        bad = np.flatnonzero(_ODD[buf])
        if len(c2 := np.flatnonzero(buf[:-1] == 0xC2)):
            bad = np.concatenate([bad, c2[buf[c2 + 1] < 0xA1]])
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        double = np.flatnonzero(white[1:] & white[:-1] & ~first[1:n]) if self.keep_white else np.zeros(0, np.int64)
        last = np.flatnonzero(white & first[1:]) if self.keep_white else np.zeros(0, np.int64)
        odd[row_of(np.concatenate([bad, double, last]))] = True
        begin = ~white
        begin[1:] &= white[:-1] | first[1:n]
        stop = ~white
        stop[:-1] &= white[1:] | first[1:n]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        before = np.where(first[starts] | (starts == 0), 0, buf[np.maximum(starts - 1, 0)]).astype(np.uint8)
        return starts, ends, before if self.keep_white else np.zeros_like(before), odd

    def entries(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The entry of each word; unseen words are encoded and kept."""
        if self.count + len(self.long) > self.limit or self.filled > self.most or self.long_bytes > self.most:
            self._clear()
        out = np.full(len(starts), -1, np.int64)
        size = ends - starts
        short = np.flatnonzero(size <= 16)
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        loads = np.ndarray(shape=(len(buf) + 9,), dtype="<u8", buffer=padded.data, strides=(1,))
        s, k = starts[short], size[short]
        lo = loads[s] & _MASK[k]
        hi = np.where(k > 8, loads[np.minimum(s + 8, len(buf))] & _MASK[np.maximum(k - 8, 0)], np.uint64(0))
        meta = (k | (before[short].astype(np.int64) << 8)).astype(np.uint16)
        out[short] = self._find(lo, hi, meta)
        miss = np.flatnonzero(out[short] < 0)
        if len(miss):
            key = np.empty(len(miss), dtype=[("lo", "<u8"), ("hi", "<u8"), ("meta", "<u2")])
            key["lo"], key["hi"], key["meta"] = lo[miss], hi[miss], meta[miss]
            order = np.lexsort((key["meta"], key["hi"], key["lo"]))
            run = key[order]
            new = np.ones(len(run), bool)
            new[1:] = run[1:] != run[:-1]
            heads = order[new]
            made = np.empty(len(heads), np.int64)
            a = short[miss[heads]]
            raw = buf.tobytes() if len(heads) > 64 else None
            for j, i in enumerate(a.tolist()):
                b, e = int(starts[i]), int(ends[i])
                word = raw[b:e] if raw is not None else buf[b:e].tobytes()
                made[j] = self._add(self.encode((bytes([before[i]]) if before[i] else b"") + word))
            self.lo[made], self.hi[made], self.meta[made] = run["lo"][new], run["hi"][new], run["meta"][new]
            self._place(made)
            back = np.empty(len(miss), np.int64)
            back[order] = made[np.cumsum(new) - 1]
            out[short[miss]] = back
        for i in np.flatnonzero(size > 16).tolist():
            word = (bytes([before[i]]) if before[i] else b"") + buf[starts[i] : ends[i]].tobytes()
            if word not in self.long:
                self.long[word] = self._add(self.encode(word))
                self.long_bytes += len(word)
            out[i] = self.long[word]
        return out

    def _place(self, made: np.ndarray) -> None:
        while self.count > 0.6 * len(self.slot):  # more unseen words in one batch than the limit foresaw
            self.slot = np.full(2 * len(self.slot), -1, np.int32)
            self.shift, self.wrap = np.uint64(int(self.shift) - 1), len(self.slot) - 1
            held = np.flatnonzero(self.meta[: self.count] > 0)
            made = np.union1d(held, made)
        at = self._hash(self.lo[made], self.hi[made], self.meta[made])
        left = np.arange(len(made))
        while len(left):
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]] = made[free]  # of several for one slot, the last stays
            won = self.slot[at[left]] == made[left]
            left = left[~won]
            at[left] = (at[left] + 1) & self.wrap

    def encode_rows(self, column: pa.Array, whole: Callable[[str], Sequence[int]], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the offsets of rows in them.

        ``whole`` encodes a whole text, for odd rows. ``end``: an id to add to each row. Rows are encoded ``PART`` bytes at a
        time (or one longer row), as the arrays by word and by id are many times the text.
        """
        buf, offsets = text_buffer(column)
        ids, sizes, a, rows = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], 0, len(offsets) - 1
        while a < rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + self.PART, "right")) - 1)
            some, at = self._encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], whole, end)
            ids.append(some)
            sizes.append(np.diff(at))
            a = b
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _encode(self, buf: np.ndarray, offsets: np.ndarray, whole: Callable[[str], Sequence[int]], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        starts, ends, before, odd = self.words(buf, offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        if odd.any():
            keep = ~odd[row]
            starts, ends, before, row = starts[keep], ends[keep], before[keep], row[keep]
        entry = self.entries(buf, starts, ends, before)
        n = self.n[entry]
        count = np.zeros(rows, np.int64)
        np.add.at(count, row, n) if len(row) < 64 else count.__iadd__(np.bincount(row, weights=n, minlength=rows).astype(np.int64))
        extra: dict[int, np.ndarray] = {}
        for r in np.flatnonzero(odd).tolist():
            extra[r] = np.asarray(whole(bytes(buf[offsets[r] : offsets[r + 1]]).decode()), dtype=self.dtype)
            count[r] = len(extra[r])
        body = gather(self.pool, self.at[entry], n)
        if not extra and end is None:
            return body, np.concatenate([[0], np.cumsum(count)])
        full = count + (end is not None)
        at = np.concatenate([[0], np.cumsum(full)])
        out = np.empty(int(at[-1]), self.dtype)
        plain = np.where(odd, 0, count)
        where = np.arange(len(body)) + np.repeat(at[:-1] - (np.cumsum(plain) - plain), plain)
        out[where] = body
        for r, ids in extra.items():
            out[at[r] : at[r] + len(ids)] = ids
        if end is not None:
            out[at[1:] - 1] = end
        return out, at


def text_slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text, or one longer row."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto
