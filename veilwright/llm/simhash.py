"""SimHash near-duplicates, found with a Gray-order hierarchical index.

A document's 64-bit fingerprint has a bit set where more than half of the hashes of its word shingles
have it. Only distinct fingerprints are compared. Two that differ in at most ``MOST`` = 3 bits agree in
one of four 16-bit blocks, so each fingerprint goes to four buckets (block, value). Past some hundred million
fingerprints, two of five blocks (or three of six) make the buckets. A bucket of more
than ``SPLIT`` fingerprints is dealt out over pairs of its parts, so no task holds more than two parts.

In a task, the fingerprints of each bucket are sorted by Gray rank, which puts those with few
differing bits side by side. Runs of them form the nodes of a tree. A node keeps the bits that all its
members share, less those its parent has already (a masked pattern). A query goes down from the
root and adds up its differences from the patterns; where the sum exceeds the limit the whole group is
left out. From each bucket only a spanning forest of the links is sent on, so a group of n near
copies costs n links and loses none of its connections.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any
other; fewer words than a shingle are one shingle; rows that share an id are fingerprinted each and
linked through equal or near fingerprints; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import _io
from veilwright.llm.components import components
from veilwright.llm.wordtable import text_buffer

MOST, SPLIT, FAN = 3, 2000, 8
#: Similarity of :func:`keep_one`, its sketches' bands and their rows, hashes, and differing hashes beyond which a pair is not looked at.
SIMILAR, BANDS, ROWS, HASHES, LOOSE = Fraction(4, 5), 20, 5, 256, 72
#: Shingles that come together in one task of :func:`similar`, about.
UNIT = 1 << 22
_TIMES, _PLUS = np.random.default_rng(8).integers(0, 2**32, (2, HASHES), dtype=np.uint32) | np.array([[1], [0]], np.uint32)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(raw: bytes, width: int, seed: int = 42, step: int = 1 << 16) -> Iterator[np.ndarray]:
    """The hashes of all word shingles, repeats included, eight bytes each, highest first."""
    words = raw.translate(_LOWER).split()
    if not words:
        return
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: max(1, len(words) - width + 1)]
    ends = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    for k in range(0, len(starts), step):
        hashes = b"".join([digest(text[a:b], seed) for a, b in zip(starts[k : k + step].tolist(), ends[k : k + step].tolist(), strict=True)])
        yield np.frombuffer(hashes, np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest first."""
    return np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(raw: bytes, width: int = 3) -> bytes:
    """Eight bytes, highest bit first."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(raw, width):
        ones += majority(hashes)
        n += len(hashes)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            raw = memoryview(buf.tobytes())
            fp = b"".join(fingerprint(bytes(raw[a:b]), width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fp, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return _io.text_rows(docs, key, text).mapInArrow(_io.tidy(work), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """A tree over codes sorted by (bucket, Gray rank)."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        self.codes = codes
        low = high = codes  # what all members have set, what any member has set
        own, levels = bucket, []
        begin = np.arange(len(codes), dtype=np.int64)
        end = begin + 1
        while True:
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            if levels and len(first) == len(own):
                break
            head = np.flatnonzero(place % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, head), np.bitwise_or.reduceat(high, head)
            below = np.append(head, len(own))
            levels.append([~(low ^ high), low, below[:-1], below[1:], end[below[1:] - 1]])
            own, begin, end = own[head], begin[head], end[below[1:] - 1]
        self.levels = levels
        for k in range(len(levels) - 1):  # keep only the bits that the parent lacks
            mask, _, _, _, _ = levels[k]
            up = levels[k + 1]
            levels[k][0] = mask & ~np.repeat(up[0], up[3] - up[2])
        top = levels[-1]
        self.leaf_mask = ~np.repeat(self._shared(low, high, 0), levels[0][3] - levels[0][2])
        self.root = np.repeat(np.arange(len(top[0])), np.diff(np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))))

    def _shared(self, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
        """All bits that the members of each node of a level share."""
        full = self.levels[-1][0]
        for k in range(len(self.levels) - 2, level - 1, -1):
            up = self.levels[k + 1]
            full = np.repeat(full, up[3] - up[2]) | self.levels[k][0]
        return full

    def links(self, query: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later code) within ``most`` differences. ``query``: places of codes."""
        q, node = query, self.root[query]
        code = self.codes[q]
        mask, value, _, _, end = self.levels[-1]
        far = np.bitwise_count((code ^ value[node]) & mask[node]).astype(np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            _, _, first, last, _ = self.levels[level]
            n = (last - first)[node]
            q, far = np.repeat(q, n), np.repeat(far, n)
            node = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[node], n)
            if level:
                mask, value, _, _, end = self.levels[level - 1]
                live = end[node] > q + 1
                q, node, far = q[live], node[live], far[live]
                far = far + np.bitwise_count((self.codes[q] ^ value[node]) & mask[node])
            else:
                live = node > q
                q, node, far = q[live], node[live], far[live]
                far = far + np.bitwise_count((self.codes[q] ^ self.codes[node]) & self.leaf_mask[node])
            near = far <= most
            q, node, far = q[near], node[near], far[near]
        return q, node


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least member linked to each of ``n`` places."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while (jump := label[label]).tolist() != label.tolist() if len(label) < 64 else not np.array_equal(jump := label[label], label):
            label = jump
        if np.array_equal(before, label):
            break
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def link_block(bucket: np.ndarray, codes: np.ndarray, part: np.ndarray, whole: np.ndarray, most: int = MOST, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Places (member, root) of a spanning forest of the links inside buckets.

    ``whole``: the bucket's inner links count; else only those between its two ``part`` s.
    """
    order = np.lexsort((gray_rank(codes), bucket))
    bucket, codes, part, whole = bucket[order], codes[order], part[order], whole[order]
    index, label = GrayIndex(bucket, codes), np.arange(len(codes))
    for k in range(0, len(codes), step):
        a, b = index.links(np.arange(k, min(k + step, len(codes))), most)
        use = whole[a] | (part[a] != part[b])
        label = forest(len(codes), a[use], b[use], label)
    child = np.flatnonzero(label != np.arange(len(codes)))
    return order[child], order[label[child]]


def masks(most: int, agree: int) -> list[int]:
    """Bit masks, as signed longs: codes within ``most`` bits agree on all bits of one of them at least.

    The 64 bits are cut into ``most + agree`` blocks, of which ``agree`` are always untouched.
    """
    cuts = [64 * k // (most + agree) for k in range(most + agree + 1)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]
    return [m - 2**64 if (m := sum(c)) >= 2**63 else m for c in combinations(blocks, agree)]


def links(codes: DataFrame, most: int = MOST, split: int = SPLIT, agree: int | None = None) -> DataFrame:
    """a, b: a spanning forest, bucket by bucket, of all pairs of distinct ``fp`` within ``most`` bits.

    ``agree``: blocks that a bucket's codes have in common. By default as many as keep buckets of evenly spread
    codes below ``split``: more blocks mean longer keys and more tables, and find the same pairs.
    """
    if agree is None:
        n, agree = codes.count(), 1
        while agree < 3 and n >> (64 * agree // (most + agree)) > split:
            agree += 1
    block = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks(most, agree)))))
    rows = _io.stash(codes.select("fp", block.alias("x")).select("fp", "x.*"), "blocks")
    large = _io.stash(rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split), "large")
    dealt = rows.join(large, ["block", "value"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / split), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("fp", "block", "value", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            fp, part, i, j, group = (np.asarray(table.column(c)) for c in ("fp", "part", "i", "j", "group"))
            child, root = link_block(group, fp.view(np.uint64), part, i == j, most)
            return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= 100_000:
                table = pa.Table.from_batches(held).combine_chunks()
                group = np.asarray(table.column("group"))
                cut = int(np.searchsorted(group, group[-1]))
                if cut:  # the last group may go on
                    yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    packed = dealt.withColumn("group", F.xxhash64("block", "value", "i", "j")).select("fp", "part", "i", "j", "group")
    return packed.repartition("group").sortWithinPartitions("group").mapInArrow(_io.tidy(work), "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable) for every row."""
    marks = _io.stash(fingerprints(docs, key, text, width), "marks")
    codes = _io.stash(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "codes")
    roots = _io.stash(components(links(codes, most)), "roots")
    linked = roots.join(codes, roots.node == codes.fp)
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    of = linked.join(least, "root").select("fp", "component")
    named = _io.stash(codes.join(of, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")), "named")
    return marks.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct shingles' hashes in order, how many shingles have each bit, and their number, repeats included."""
    ones, n, parts = np.zeros(64, np.int64), 0, [np.zeros(0, np.uint64)]
    for hashes in shingle_hashes(raw, width):
        ones += majority(hashes)
        n += len(hashes)
        parts.append(np.unique(np.ascontiguousarray(hashes).view(">u8")[:, 0].astype(np.uint64)))
    return np.unique(np.concatenate(parts)) if len(parts) > 2 else parts[-1], ones, n


def sketch(raw: bytes, width: int) -> tuple[bytes, np.ndarray, bytes, int, int]:
    """The fingerprint, the keys of ``BANDS`` bands of least hashes, two bits of each of ``HASHES`` least hashes, and
    the hash and the size of the shingle set."""
    own, ones, n = shingles(raw, width)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    top = (own >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(top), 1024):
        np.minimum(least, (top[k : k + 1024, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(31)) ^ keys[:, k]) * np.uint64(0x9E3779B97F4A7C15)
    pairs = ((least * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint8)
    bits = np.packbits(np.stack([pairs >> 1, pairs & 1], axis=1).ravel()).tobytes()
    return np.packbits(2 * ones > n).tobytes(), key, bits, xxhash.xxh64_intdigest(own.tobytes(), 7) - (1 << 63), len(own)


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, mark (SHA-256 of the text), fp, node (hash of the shingle set), size (shingles), bands, bits (longs of the sketch) for every row."""
    longs = HASHES // 32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(2))
            raw = memoryview(buf.tobytes())
            made = [sketch(bytes(raw[a:b]), width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            fps = np.frombuffer(b"".join(x[0] for x in made), ">i8").astype(np.int64)
            bands = np.concatenate([x[1] for x in made]).view(np.int64) if made else np.zeros(0, np.int64)
            bits = np.frombuffer(b"".join(x[2] for x in made), ">i8").astype(np.int64)
            each = lambda n: pa.array(np.arange(len(made) + 1, dtype=np.int32) * n)
            node, size = (pa.array([x[k] for x in made], pa.int64()) for k in (3, 4))
            columns = [batch.column(0), batch.column(1), pa.array(fps), node, size, pa.ListArray.from_arrays(each(BANDS), pa.array(bands)), pa.ListArray.from_arrays(each(longs), pa.array(bits))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "fp", "node", "size", "bands", "bits"])

    rows = _io.text_rows(docs, key, text)
    kind = "doc_id long, mark string, fp long, node long, size long, bands array<long>, bits array<long>"
    return rows.select("doc_id", F.sha2("text", 256).alias("mark"), "text").mapInArrow(_io.tidy(work), kind)


def differ(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many of the ``HASHES`` bit pairs a sketch differs from each of others."""
    x = others ^ own
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def meet_block(keys: list[np.ndarray], alike: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of places that share a key and are alike.

    Breadth first: a place is tested against all partners not yet reached, so no link that connects is left out, and
    a tight group costs little more than a test a member.
    """
    count = np.fromiter(map(len, keys), np.int64, len(keys))
    flat, place = np.concatenate([np.zeros(0, np.int64), *keys]), np.repeat(np.arange(len(keys)), count)
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order])) + 1
    members = np.split(place[order], cuts)
    of = {int(flat[order[k]]): n for n, k in enumerate([0, *cuts.tolist()])} if len(flat) else {}
    reached = np.zeros(len(keys), bool)
    for start in range(len(keys)):
        if reached[start]:
            continue
        reached[start] = True
        todo = [start]
        while todo:
            here = todo.pop()
            met = []
            for k in keys[here].tolist():
                left = members[of[k]]
                if len(left):
                    left = members[of[k]] = left[~reached[left]]
                    met.append(left)
            near = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            if len(near):
                near = near[alike(here, near)]
                reached[near] = True
                todo += near.tolist()
                yield from ((here, x) for x in near.tolist())


def meetings(keys: DataFrame, sizes: DataFrame, unit: int | None = None) -> DataFrame:
    """node, group, keys: which nodes come together, so that any two that share a key do so in one group at least.

    ``keys`` has node and key, ``sizes`` node and size. Nodes that keys connect make up one group where their sizes
    sum up to ``unit`` or less. Otherwise each key is a group, dealt out over pairs of its parts if it is larger.
    """
    unit = unit or UNIT
    ends = _io.stash(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key", "low"), "bands")
    met = _io.stash(keys.join(ends, "key").select("node", "key", "low").distinct(), "met")
    roots = components(met.select(F.col("node").alias("a"), F.col("low").alias("b")))
    roots = _io.stash(roots.join(sizes, "node"), "meetings")
    whole = roots.groupBy("root").agg(F.sum("size").alias("whole"))
    met = met.join(roots.join(whole, "root"), "node").select("node", "key", "root", "size", "whole")
    small = met.filter(F.col("whole") <= unit).groupBy("node", "root").agg(F.collect_set("key").alias("keys")).select("node", F.xxhash64("root").alias("group"), "keys")
    large = _io.stash(met.filter(F.col("whole") > unit).select("node", "key", "size"), "large")
    total = F.col("total")
    parts = large.groupBy("key").agg(F.sum("size").alias("total")).select("key", F.when(total <= unit, 1).otherwise(F.ceil(2 * total / unit)).cast("int").alias("parts"))
    dealt = large.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.filter("parts = 1 or part <> other").select("node", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("group"), F.array("key").alias("keys"))
    return small.unionByName(dealt)


def share(own: np.ndarray, others: list[np.ndarray], least: Fraction = SIMILAR) -> np.ndarray:
    """Which sets (sorted) have a Jaccard similarity of ``least`` or more to ``own``; two empty ones have."""
    n = np.fromiter(map(len, others), np.int64, len(others))
    out = np.minimum(n, len(own)) * least.denominator >= np.maximum(n, len(own)) * least.numerator
    for k in np.flatnonzero(out & (n > 0)).tolist():
        at = np.searchsorted(own, others[k])
        both = int((own[np.minimum(at, len(own) - 1)] == others[k]).sum())
        out[k] = both * least.denominator >= (len(own) + int(n[k]) - both) * least.numerator
    return out


def similar(docs: DataFrame, marks: DataFrame, codes: DataFrame, key: str, text: str, width: int, least: Fraction = SIMILAR) -> DataFrame:
    """a, b: nodes, a spanning forest, group by group, of all pairs whose shingle sets have a Jaccard similarity of ``least`` or
    more, among those that share a band or a component of fingerprints within ``MOST`` bits.

    Sketches only leave out pairs far below: ``LOOSE`` differing hashes lie six deviations above what similar sets have. What is left is computed
    from the texts, of which only the nodes' that share a key move.
    """
    fps = marks.select("node", "fp").distinct()
    roots = _io.stash(components(links(fps.select("fp").distinct())), "roots").withColumnRenamed("node", "fp")
    gray = fps.join(roots, "fp", "left").select("node", F.xxhash64(F.coalesce("root", "fp"), F.lit("fp")).alias("key"))
    keys = marks.select("node", F.explode("bands").alias("key")).unionByName(gray)
    packs = meetings(keys, marks.select("node", (F.col("size") + 16).alias("size")).distinct())
    bits = marks.groupBy("node").agg(F.first("bits").alias("bits"))
    one = codes.select("node", "first.doc_id", "first.mark").join(bits, "node")
    packs = _io.stash(packs.join(one, "node").select("group", "node", "keys", "bits", "doc_id", "mark"), "packs")
    words = _io.text_rows(docs, key, text).withColumnRenamed("doc_id", "k").withColumn("m", F.sha2("text", 256))
    rows = words.join(packs, (words.m == packs.mark) & words.k.eqNullSafe(packs.doc_id)).select("group", "node", "keys", "bits", "text")

    def solve(table: pa.Table) -> pa.RecordBatch:
        nodes = np.asarray(table.column("node"))
        bits = np.array(table.column("bits").to_pylist(), np.int64).view(np.uint64)
        keys = [np.array(x, np.int64) for x in table.column("keys").to_pylist()]
        sets = [shingles(x.as_py().encode(), width)[0] for x in table.column("text")]

        def alike(here: int, near: np.ndarray) -> np.ndarray:
            out = differ(bits[here], bits[near]) <= LOOSE
            out[out] = share(sets[here], [sets[k] for k in near[out].tolist()], least)
            return out

        a, b = np.array(list(meet_block(keys, alike)), np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return by_group(rows, solve, "a long, b long")


def by_group(rows: DataFrame, solve: Callable[[pa.Table], pa.RecordBatch], kind: str) -> DataFrame:
    """``solve`` for the rows of each ``group``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            group = np.asarray(batch.column("group"))
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and group[a] != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = group[a]
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_io.tidy(work), kind)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: Fraction = SIMILAR) -> DataFrame:
    """The rows that stay, one of each group (that of the least id, a null id last), with all their columns.

    A group is linked by pairs whose shingle sets have a Jaccard similarity of ``least`` or more. Texts that share four
    fifths of their five-word shingles differ in more bits (five to fourteen where measured) than the
    index finds, so a banded sketch of least hashes adds candidates; each is judged by the shingle sets themselves.
    """
    marks = _io.stash(sketches(docs, key, text, width), "sketches")
    rows = marks.groupBy("node", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "mark", "n")
    codes = _io.stash(rows.groupBy("node").agg(F.min(first).alias("first")), "codes")
    roots = _io.stash(components(similar(docs, marks, codes, key, text, width, least)), "roots")
    grouped = codes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    stay = grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark", "first.n")
    return _io.keep_rows(docs, _io.stash(stay, "stay"), key, F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_io.read(spark, sf_dir, "documents"))
