"""Trees of source files as tables, and copies of trees as a sink.

Spark's own file source leaves out names that begin with a dot or an underscore, so trees are listed here, and files are opened by the
executors.
"""

from __future__ import annotations

import os
import posixpath
import shutil
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.fixed import TEXT_EXTENSIONS
from veilwright.functions.text import decoded
from veilwright.sources.shared import stash


def is_text(path: str) -> bool:
    """By its suffix, or for want of one."""
    suffix = os.path.splitext(path.rstrip("/").rsplit("/", 1)[-1])[1].lower()
    return suffix in TEXT_EXTENSIONS or suffix == ""


def within(path: str, root: str) -> bool:
    path, root = os.path.realpath(path), os.path.realpath(root)
    return path == root or path.startswith(root.rstrip("/") + "/")


def _entries(folder: str, skip: list[str]) -> tuple[list[str], list[str]]:
    """Files and folders right below a folder; links to folders are left out."""
    names, folders = [], []
    with os.scandir(folder) as found:
        for x in found:
            if any(within(x.path, s) for s in skip):
                continue
            if x.is_dir(follow_symlinks=False):
                folders.append(x.path)
            elif os.path.isfile(x.path):
                names.append(x.path)
    return names, folders


def listed(spark: SparkSession, root: str, skip: Iterable[str] = (), most: int = 1000) -> DataFrame:
    """file (relative name), path, size of all files below a folder, or of the one file.

    The driver goes through folders until it has met ``most`` names; what is left of them goes to the executors, a folder a task.
    """
    kind, skip = "file string, path string, size long", [s for s in skip if s]
    if os.path.isfile(root):
        return spark.createDataFrame([(os.path.basename(root), root, os.path.getsize(root))], kind)
    row = lambda path: (posixpath.join(*os.path.relpath(path, root).split(os.sep)), path, os.path.getsize(path))
    names, todo = [], deque([root])
    while todo and len(names) + len(todo) < most:
        own, folders = _entries(todo.popleft(), skip)
        names += own
        todo += folders
    near = spark.createDataFrame([row(x) for x in names], kind)
    if not todo:
        return near

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column(0).to_pylist()
            while left:
                own, folders = _entries(left.pop(), skip)
                left += folders
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*map(row, own), strict=True)], ["file", "path", "size"])

    far = spark.createDataFrame([(x,) for x in todo], "folder string").repartition(len(todo)).mapInArrow(walk, kind)
    return near.unionByName(far)


def has_text(file: Column) -> Column:
    """:func:`is_text` of a column."""
    name = F.ltrim(F.regexp_extract(file, "([^/]*)$", 1), F.lit("."))
    return F.lower(F.regexp_extract(name, "(\\.[^.]*)$", 1)).isin("", *TEXT_EXTENSIONS)


def _dealt(names: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """The names, written once and dealt out so that a partition holds about ``part_bytes`` of files."""
    names = stash(names, "names")
    n, total = names.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return names.repartition(max(1, min(n, max(names.sparkSession.sparkContext.defaultParallelism * 4, total // part_bytes))))


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with open(path, "rb") as f:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([f.read()], pa.binary())], ["file", "content"])


def contents(names: DataFrame) -> DataFrame:
    """file, content (bytes) of listed files."""
    return _dealt(names).select("file", "path").mapInArrow(_load, "file string, content binary")


def texts(spark: SparkSession, root: str, skip: Iterable[str] = (), without: Iterable[str] = ()) -> DataFrame:
    """file, text (newlines normalized) of a tree's text files; ``without``: paths to leave out, such as rosters."""
    names = _without(listed(spark, root, skip).filter(has_text(F.col("file"))), root, without)
    return contents(names).select("file", decoded(F.col("content")).alias("text"))


def _without(names: DataFrame, root: str, without: Iterable[str]) -> DataFrame:
    own = [os.path.relpath(os.path.realpath(p), os.path.realpath(root)).replace(os.sep, "/") for p in without]
    return names.filter(~F.col("file").isin(own)) if own else names


def one_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    """file, text of one file under a given name."""
    rows = spark.createDataFrame([(name, path)], "file string, path string")
    return rows.mapInArrow(_load, "file string, content binary").select("file", decoded(F.col("content")).alias("text"))


def write_tree(spark: SparkSession, root: str, out: str, changed: DataFrame, skip: Iterable[str] = (), without: Iterable[str] = ()) -> None:
    """Copy a tree: text files from ``changed`` (file, text) as UTF-8 with LF, all others byte for byte.

    ``without``: files that must not reach the copy, such as rosters inside the input. Files are written
    under a name of their own and renamed, so a rerun task leaves whole files.
    """
    plain = _without(listed(spark, root, [out, *skip]).filter(~has_text(F.col("file"))), root, without)

    def save(rows: Iterator) -> None:
        for row in rows:
            target = os.path.join(out, row.file)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(row.text)
            os.replace(part, target)

    def copy(rows: Iterator) -> None:
        for row in rows:
            target = os.path.join(out, row.file)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            shutil.copy2(row.path, target)

    os.makedirs(out, exist_ok=True)
    changed.select("file", "text").foreachPartition(save)
    _dealt(plain).foreachPartition(copy)
