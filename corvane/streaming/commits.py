"""Several tables written as one: a numbered commit is its folders and one manifest that makes them visible.

Tables of a commit go to folders of their own attempt; then one file, renamed into place, names them.  Readers follow the
manifests only, so a writer that dies leaves folders that nobody reads, and a commit that is repeated is passed over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(target: str, number: int) -> str:
    return f"{target}/_commits/{number:019d}.json"


def committed(spark: SparkSession, target: str, number: int) -> bool:
    path, fs = _fs(spark, _manifest(target, number))
    return fs.exists(path)


def commit(spark: SparkSession, target: str, number: int, tables: dict[str, DataFrame]) -> bool:
    """Writes the tables of a commit; False where it is there already."""
    if committed(spark, target, number):
        return False
    attempt = uuid.uuid4().hex
    folders = {}
    for name, df in tables.items():
        folders[name] = f"{target}/{name}/commit={number}/{attempt}"
        df.write.parquet(folders[name])
    draft, fs = _fs(spark, f"{target}/_drafts/{attempt}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"number": number, "folders": folders}).encode()))
    out.close()
    final, _ = _fs(spark, _manifest(target, number))
    fs.mkdirs(final.getParent())
    return bool(fs.rename(draft, final))  # another attempt may have been first; its folders count then


def manifests(spark: SparkSession, target: str, after: int = -1) -> list[dict]:
    """The commits in order: a name and a folder for each table of each commit."""
    path, fs = _fs(spark, f"{target}/_commits")
    if not fs.exists(path):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(path)]
    wanted = [n for n in names if n.endswith(".json") and int(n.rsplit("/", 1)[1][:-5]) > after]
    return sorted((json.loads(r[0]) for r in spark.read.text(wanted, wholetext=True).collect()), key=lambda m: m["number"]) if wanted else []  # small files, one a commit


def read(spark: SparkSession, target: str, table: str, schema: str, after: int = -1) -> DataFrame:
    """All committed rows of a table, with the number of their commit."""
    folders = [m["folders"][table] for m in manifests(spark, target, after) if table in m["folders"]]
    if not folders:
        return spark.createDataFrame([], schema).withColumn("commit", F.lit(None).cast("bigint"))
    rows = spark.read.schema(schema).parquet(*folders)
    return rows.withColumn("commit", F.regexp_extract("_metadata.file_path", r"/commit=(\d+)/", 1).cast("bigint"))


def latest(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the rows of the last commit that has written it; groups: keys and commit, a row for each group that a commit has (re)written."""
    last = groups.groupBy(*keys).agg(F.max("commit").alias("_last"))
    same = [rows[k].eqNullSafe(last[k]) for k in keys]
    on = rows["commit"] == last["_last"]
    for s in same:
        on = on & s
    return rows.join(last, on, "left_semi")
