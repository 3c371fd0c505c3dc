"""Token-id shards with a minimal perfect hash index over document keys.

Documents are dealt out by ranges of their key, sorted, encoded, and written as shard files into the
shared folder. A shard is::

    magic | raw ids, document after document | key index | sizes of documents | trailer (JSON) | its length | magic

The index is a minimal perfect hash: levels of bit arrays, in each of which a key that no other key
of that level meets gets the rank of its bit. At each rank stands an entry: a 64-bit fingerprint of the key
(which turns away strangers), its first document, how many have the key, and where their ids start. A lookup hashes the key, reads
one entry and one slice of the payload, whatever the size of the shard.

Keys find their shards by a manifest (a row a shard, written sorted to the shared folder): keys are dealt out by ranges, and each
task reads the rows of the manifest that meet its range. They go on to one task a shard or a few, and are fetched there; reads of
documents that lie side by side are one read. :meth:`TokenStore.documents` is such a lookup of all keys.

Defined cases: a null or empty text has the end id alone; a null key sorts first and is counted in the trailer, apart from all
other keys; rows that share a key lie side by side (ordered by a hash of the text)
and a lookup gives all of them; an empty table gives no shard; further columns are ignored.
A lost executor costs a rerun of its tasks: every attempt writes a file of its own name and only
files in the manifest are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.llm import _io, tokenizer
from veilwright.llm.wordtable import text_slices

MAGIC = b"VWTOKEN1"
ENTRY = np.dtype([("mark", "<u8"), ("doc", "<i8"), ("run", "<i8"), ("start", "<i8")])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: ``rank`` maps them onto 0 .. n-1."""

    GAMMA, LEVELS = 2.0, 64

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        self.before, total = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, sizes = keys.astype(np.int64), [], []
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = max(64, int(cls.GAMMA * len(left)))
            at = (mix(left.view(np.uint64), level + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view(np.uint64)
            levels.append(bits)
            sizes.append(size)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys are not distinct")
        return cls(levels, sizes)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Ranks; -1 where a key meets no bit at all. A stranger may get any rank."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if not len(left):
                break
            at = (mix(keys[left].view(np.uint64), level + 1) % np.uint64(size)).astype(np.int64)
            word = bits[at >> 6]
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[left[hit]] = self.before[level][at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64), 0xF1)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams documents of ascending key (null first) into one shard file."""

    def __init__(self, uri: str, dtype: str):
        store, path = _filesystem(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.dtype, self.out = uri, np.dtype(dtype), store.open_output_stream(path)
        self.out.write(MAGIC)
        self.keys: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.tokens = self.nulls = 0

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(ids, self.dtype).tobytes())
        self.nulls += keys.null_count
        self.keys.append(np.asarray(keys.drop_null(), dtype=np.int64))
        self.sizes.append(sizes.astype(np.int64))
        self.tokens += len(ids)

    def close(self) -> dict:
        keys, sizes = np.concatenate(self.keys), np.concatenate(self.sizes)
        starts = np.cumsum(sizes) - sizes
        own, first, count = np.unique(keys, return_index=True, return_counts=True)
        index = PerfectHash.build(own)
        rank = index.rank(own)
        entries = np.zeros(len(own), ENTRY)
        first = first + self.nulls
        entries["mark"][rank], entries["doc"][rank], entries["run"][rank], entries["start"][rank] = fingerprint(own), first, count, starts[first]
        parts = {f"level{k}": x for k, x in enumerate(index.levels)} | {"entries": entries, "sizes": sizes}
        at, where = len(MAGIC) + self.tokens * self.dtype.itemsize, {}
        for name, x in parts.items():
            raw = x.tobytes()
            self.out.write(raw)
            where[name] = [at, len(x)]
            at += len(raw)
        tail = json.dumps({"dtype": self.dtype.str, "tokens": self.tokens, "nulls": self.nulls, "sizes": index.sizes, "parts": where}).encode()
        self.out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
        self.out.close()
        low, high = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        return {"file": self.uri, "n_docs": len(sizes), "n_tokens": self.tokens, "n_null": self.nulls, "min_key": low, "max_key": high}


class Shard:
    """Random access to one shard file. Only the levels of its index are held; entries, sizes and ids are read by slices."""

    def __init__(self, uri: str):
        store, path = _filesystem(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        head, foot = self.file.read_at(len(MAGIC), 0), self.file.read_at(16, end - 16)
        if head != MAGIC or foot[8:] != MAGIC:
            raise ValueError(f"not a whole shard: {uri}")
        n = int.from_bytes(foot[:8], "little")
        self.about = json.loads(self.file.read_at(n, end - 16 - n))
        self.dtype, self.nulls = np.dtype(self.about["dtype"]), self.about["nulls"]
        self.index = PerfectHash([self._part(f"level{k}", np.dtype("<u8")) for k in range(len(self.about["sizes"]))], self.about["sizes"])

    def _part(self, name: str, kind: np.dtype, low: int = 0, high: int | None = None) -> np.ndarray:
        at, n = self.about["parts"][name]
        high = n if high is None else high
        return np.frombuffer(self.file.read_at((high - low) * kind.itemsize, at + low * kind.itemsize), kind)

    def _entries(self, rank: np.ndarray) -> np.ndarray:
        """Entries at ranks: one by one, or all at once where a good part of them is asked for."""
        n = self.about["parts"]["entries"][1]
        if 64 * len(rank) > n:
            return self._part("entries", ENTRY)[rank]
        return np.concatenate([np.zeros(0, ENTRY), *(self._part("entries", ENTRY, k, k + 1) for k in rank.tolist())])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """(first document, documents, first id) of each key; no documents if it is absent."""
        out = np.zeros(len(keys), [("doc", "<i8"), ("run", "<i8"), ("start", "<i8")])
        rank = self.index.rank(keys)
        known = np.flatnonzero(rank >= 0)
        if len(known):
            entry = self._entries(rank[known])
            own = entry["mark"] == fingerprint(keys[known])
            for name in out.dtype.names:
                out[name][known[own]] = entry[name][own]
        return out

    def fetch(self, places: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Documents of what :meth:`find` gave, in that order: (place, first id, size, all ids) of about ``step`` ids at a time.

        Runs that lie side by side are read together.
        """
        live = np.flatnonzero(places["run"] > 0)
        if not len(live):
            return
        doc, run = places["doc"][live], places["run"][live]
        joined = np.flatnonzero(np.append(True, doc[1:] != doc[:-1] + run[:-1]))
        for a, b in zip(joined.tolist(), [*joined[1:].tolist(), len(live)], strict=True):
            low, high = int(doc[a]), int(doc[b - 1] + run[b - 1])
            sizes = self._part("sizes", np.dtype("<i8"), low, high)
            of, first = np.repeat(live[a:b], run[a:b]), int(places["start"][live[a]])
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                done = int(ends[at - 1]) if at else 0
                upto = min(max(at + 1, int(np.searchsorted(ends, done + step, "right"))), len(sizes), at + 50_000)
                total = int(ends[upto - 1]) - done
                ids = np.frombuffer(self.file.read_at(total * self.dtype.itemsize, len(MAGIC) + (first + done) * self.dtype.itemsize), self.dtype)
                yield of[at:upto], first + ends[at:upto] - sizes[at:upto], sizes[at:upto], ids
                at = upto


@lru_cache(maxsize=2)
def _shard(uri: str) -> Shard:
    return Shard(uri)


Found = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]  # keys, first ids, sizes, all ids


@dataclass(frozen=True)
class TokenStore:
    """A written store. ``manifest``: a Parquet folder of file, n_docs, n_tokens, n_null, min_key, max_key, base (ids before it), in order."""

    spark: SparkSession
    manifest: str
    shards: int

    def documents(self, keys: DataFrame, key: str = "doc_id", step_tokens: int = 4_000_000) -> DataFrame:
        """What the files hold of these keys' documents: doc_id, start, n_tokens, ids_crc32."""

        def digest(found: Found) -> pa.RecordBatch:
            own, start, size, ids = found
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = 4 * np.cumsum(size)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * size).tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([own, pa.array(start), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return self._fetched(keys, key, digest, "doc_id long, start long, n_tokens long, ids_crc32 long", step_tokens)

    def lookup(self, keys: DataFrame, key: str = "doc_id", step_tokens: int = 1_000_000) -> DataFrame:
        """Ids of the documents with these keys: doc_id, start, ids. Unknown keys give no row."""

        def whole(found: Found) -> pa.RecordBatch:
            own, start, size, ids = found
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids.astype(np.int64)))
            return pa.RecordBatch.from_arrays([own, pa.array(start), lists], ["doc_id", "start", "ids"])

        return self._fetched(keys, key, whole, "doc_id long, start long, ids array<long>", step_tokens)

    def routed(self, keys: DataFrame, key: str) -> DataFrame:
        """file, base, key: each distinct key with every shard whose range holds it."""
        path = self.manifest

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import dataset

            store, own = _filesystem(path)
            table = dataset.dataset(own, filesystem=store, format="parquet")
            field = dataset.field
            for batch in batches:
                column = batch.column(0)
                want = np.asarray(column.drop_null(), dtype=np.int64)  # ascending
                meets = field("n_null") > 0 if column.null_count else None
                if len(want):
                    inside = (field("min_key") <= int(want[-1])) & (field("max_key") >= int(want[0]))
                    meets = inside if meets is None else meets | inside
                if meets is None:
                    continue
                for row in table.to_table(columns=["file", "base", "n_null", "min_key", "max_key"], filter=meets).to_pylist():
                    got: list[int | None] = [None] if column.null_count and row["n_null"] else []
                    if row["min_key"] is not None:
                        a, b = np.searchsorted(want, [row["min_key"]], "left")[0], np.searchsorted(want, [row["max_key"]], "right")[0]
                        got += want[a:b].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(got), pa.string()), pa.array([row["base"]] * len(got), pa.int64()), pa.array(got, pa.int64())], ["file", "base", "key"])

        own = keys.select(F.col(f"`{key}`").cast("long").alias("key")).distinct()
        return own.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_io.tidy(route), "file string, base long, key long")

    def _fetched(self, keys: DataFrame, key: str, make: Callable[[Found], pa.RecordBatch], schema: str, step: int) -> DataFrame:
        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                files = batch.column(0).to_pylist()
                cuts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    shard, base, own = _shard(files[a]), batch.column(1)[a].as_py(), batch.column(2).slice(a, b - a)
                    places = np.concatenate([np.array([(0, shard.nulls, 0)] * own.null_count, [("doc", "<i8"), ("run", "<i8"), ("start", "<i8")]), shard.find(np.asarray(own.drop_null(), dtype=np.int64))])
                    for of, start, size, ids in shard.fetch(places, step):
                        yield make((own.take(pa.array(of)), base + start, size, ids))

        dealt = self.routed(keys, key).repartition(max(1, self.shards), "file").sortWithinPartitions("file", "key")
        return dealt.mapInArrow(_io.tidy(fetch), schema)


def write_store(
    docs: DataFrame, tokenizer_path: str, end_id: int | None, key: str = "doc_id", text: str = "text", spaced: bool = False, shard_tokens: int = 32_000_000, folder: str | None = None
) -> TokenStore:
    """Encode whole texts, append ``end_id`` to each, and write shards in ascending key order.

    ``spaced``: the vocabulary keeps white space (byte-level); ``shard_tokens``: a shard is closed
    at the first document past it.
    """
    spark = docs.sparkSession
    folder = folder or _io.scratch(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        table, whole = tokenizer.word_table(tokenizer_path, spaced), tokenizer.whole(tokenizer_path)
        kind = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_tokens", "n_null", "min_key", "max_key", "pid", "seq"))])
        writer, seq = None, 0
        for batch in text_slices(batches, 1, min(4_000_000, 4 * shard_tokens)):
            ids, at = table.encode_rows(batch.column(1), whole, end_id)
            writer = writer or ShardWriter(f"{name}-{seq:04d}.vwt", table.dtype)
            writer.add(batch.column(0), ids, np.diff(at))
            if writer.tokens >= shard_tokens:
                yield pa.RecordBatch.from_pylist([writer.close() | {"pid": task.partitionId(), "seq": seq}], schema=kind)
                writer, seq = None, seq + 1
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close() | {"pid": task.partitionId(), "seq": seq}], schema=kind)

    ordered = _io.text_rows(docs, key, text).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows = _io.stash(ordered.mapInArrow(_io.tidy(write), "file string, n_docs long, n_tokens long, n_null long, min_key long, max_key long, pid long, seq long"), "shards")
    past = Window.orderBy("pid", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    manifest = _io.scratch(spark, "manifest")
    rows.withColumn("base", F.coalesce(F.sum("n_tokens").over(past), F.lit(0).cast("long"))).drop("pid", "seq").write.parquet(manifest)
    return TokenStore(spark, manifest, rows.count())


def op1(tokenizer_path: str, end_id: int = 2) -> Callable[[SparkSession, str], DataFrame]:
    """All documents' keys, looked up in the store."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _io.read(spark, sf_dir, "documents")
        return write_store(docs, tokenizer_path, end_id).documents(docs)

    return query
