"""Stored tables that are derived from a source and known to be up to date with it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import scratch_folder


def watermark(source: DataFrame) -> str:
    """What files a table has, with their sizes and times: changes whenever rows are added, removed or rewritten.

    Reads no column of the source; partial aggregates leave a row a file, and one row reaches the driver.
    """
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    one = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")).alias("h")).head()
    return f"{one.n}-{int(one.h or 0)}"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_for(source: DataFrame, name: str, build: Callable[[str], None], layout: int = 1) -> str:
    """The folder of what `build(folder)` derives from the source as it is now.

    layout: a number that grows whenever what `build` writes changes.  Folders are named by it and by the source's watermark, so a changed source gets a new one and readers of the old one are not
    disturbed.  What is built becomes visible by one rename, when it is whole: a builder that dies leaves nothing that
    is ever read, and of two at a time one wins.
    """
    spark = source.sparkSession
    final = f"{scratch_folder(spark)}/indexes/{name}-{layout}/{watermark(source)}"
    path, fs = _path(spark, final)
    if not fs.exists(path):
        draft = f"{scratch_folder(spark)}/indexes/.drafts/{name}-{uuid.uuid4().hex}"
        build(draft)
        fs.mkdirs(path.getParent())
        here, _ = _path(spark, draft)
        if not fs.rename(here, path) and not fs.exists(path):
            raise OSError(f"{draft} could not be renamed to {final}")
    return final
