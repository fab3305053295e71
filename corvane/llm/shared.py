"""Helpers shared by the operators: block-wise Arrow maps and lineage cuts in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import textkit

#: Bytes of text that one step of a block-wise operator sees, unless a single row is longer.
BLOCK = 4 << 20


#: By application, the temporary folder used in local mode.
_FOLDERS: dict[str, str] = {}


def shared_folder(df: DataFrame) -> str:
    """The cluster's folder for intermediate tables (spark.checkpoint.dir); a temporary one only in local mode, where it is unset."""
    spark = df.sparkSession
    found, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found and app not in _FOLDERS:
        _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return found or _FOLDERS[app]


#: Arrow batches between the JVM and Python are cut to so many bytes, so that workers and off-heap buffers stay small.
BATCH = "8m"


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's size of Arrow batches, unless it has been set to less already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m") in ("67108864b", "64m"):
        conf.set(key, BATCH)
    return df


def give_back() -> None:
    """Returns freed memory of an idle Python worker to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that lost executors cost no recomputation."""
    small_batches(df)
    path = f"{shared_folder(df).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables; only for those that no plan still to be run reads."""
    for table in tables:
        path, spark = _PATHS.pop(table, None), table.sparkSession
        if path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Holds the caller's columns while an operator works, so that its own names cannot clash with theirs.
CALLER = "_caller"


def wrapped(docs: DataFrame, text: str, *own: Column, keep: list[str] | None = None) -> DataFrame:
    """The caller's columns but the text as one struct, the operator's own columns, and the text as `_text`."""
    names = [c for c in (docs.columns if keep is None else keep) if c != text]
    packed = F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.lit(None).cast("struct<>")
    return docs.select(packed.alias(CALLER), *own, F.col(f"`{text}`").alias("_text"))


def unwrapped(df: DataFrame, names: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The caller's columns again, some of them replaced."""
    changed = changed or {}
    return df.select(*((changed[c] if c in changed else F.col(CALLER).getField(c)).alias(c) for c in names))


#: By owner, what frees the memory that an operator keeps in a Python worker between its tasks.
_KEPT: dict[str, Callable[[], object]] = {}


def keeps_memory(owner: str, release: Callable[[], object]) -> None:
    _KEPT[owner] = release


def release_others(owner: str) -> None:
    """Python workers are reused by Spark; an operator that starts frees what others have left there."""
    for name, release in _KEPT.items():
        if name != owner:
            release()


def text_blocks(fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], text: str, limit: int = BLOCK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: calls fn(rows, utf8 bytes, offsets) on blocks of rows with at most `limit` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(fn.__module__)
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, offs = textkit.flatten(batch.column(batch.schema.get_field_index(text)))
            for lo, hi in textkit.blocks(offs, limit):
                yield fn(batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            batch = buf = offs = None
        give_back()

    return run


def shuffle_or_broadcast(small: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Marks a stored table for broadcast if its measured size is below `limit` bytes; else the join shuffles both sides."""
    rows, size = small.agg({"*": "count"}).collect()[0][0], sum({"bigint": 8, "int": 4, "double": 8, "boolean": 1}.get(kind, 0) for _, kind in small.dtypes)
    for name, kind in small.dtypes:
        if kind in ("string", "binary") and rows * 64 < limit:
            size += (small.agg(F.sum(F.octet_length(name))).collect()[0][0] or 0) / max(rows, 1)
        elif kind in ("string", "binary"):
            size += 64
    return F.broadcast(small) if rows * (size + 32) < limit else small


def bounded_sample(df: DataFrame, rows: int, *key: Column) -> DataFrame:
    """The `rows` rows with the least hashes of their key, from the whole table; all, where there are no more.

    A threshold from the number of rows leaves about one and a half times as many, so that what each partition sends on
    does not grow with the number of partitions.
    """
    n = df.count()
    if n <= rows:
        return df
    h = F.xxhash64(F.lit(11), *key)
    return df.where(F.shiftrightunsigned(h, 11) / float(1 << 53) < 1.5 * rows / n + 100 / n).orderBy(h).limit(rows)
