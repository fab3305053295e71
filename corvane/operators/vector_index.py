"""A stored vector index: trained cells as partition folders, multi-probe search, exact completion by angle bounds.

Every row is indexed.  Cells are the clusters of a bounded sample (spherical k-means); a vector lies in the folder of the
cell with the nearest centre, and a cell's row in `cells` has its centre, its rows and the widest angle of its members.
A search reads the folders of the cells that it probes only.  An exact search adds the cells whose bound (the cosine of
the query's angle to the centre less the widest angle) reaches the k-th score found so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import cut

#: Grows when the stored form changes.
LAYOUT = 2
#: Rows that the cells are trained on, at most; cells at most; vectors of one file and queries of one block.
SAMPLE_ROWS, MOST_CELLS, FILE_ROWS, QUERY_ROWS = 20_000, 4096, 65_536, 4096
#: Rows whose exact answers set the number of probes, and the share of those answers that it has to reach.
TUNING_ROWS, RECALL = 64, 0.95
#: Digits of a cosine that count: equal vectors tie, and ties go to the smaller id.
DIGITS = 9


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors stay."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def train(units: DataFrame, cells: int) -> np.ndarray:
    """Centres of the cells, by spherical k-means over at most SAMPLE_ROWS rows with the least hashes of their id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = units.count()
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(n, 1))
    h = F.xxhash64(F.lit(17), "id")
    sample = units.where(F.exists("unit", lambda x: x != 0) & (F.pmod(h, F.lit(1 << 30)) < share * (1 << 30))).orderBy(h).limit(SAMPLE_ROWS)
    rows = cut(sample.select(array_to_vector("unit").alias("features")), "cell-sample")
    if rows.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=max(2, cells), seed=7, maxIter=12, distanceMeasure="cosine").fit(rows)
    return _units(np.array([c for c in model.clusterCenters()]))


def build(rows: DataFrame, folder: str, *, row_id: str = "id", vector: str = "vector", cells: int | None = None) -> None:
    """Indexes every row with a vector; cells: about the root of the number of rows where none is given."""
    doubles = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(row_id).alias("id"), F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    units = cut(doubles.withColumn("size", size).select("id", F.transform("v", lambda x: x / F.when(F.col("size") > 0, F.col("size")).otherwise(1.0)).alias("unit")), "units")
    centres = train(units, cells or min(MOST_CELLS, max(4, round(math.sqrt(units.count())))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            near = x @ centres.T if centres.shape[1] == x.shape[1] else np.zeros((len(x), len(centres)))
            cell = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "unit", "cell", "angle"])

    placed = cut(units.mapInArrow(place, f"id {dict(units.dtypes)['id']}, unit array<double>, cell int, angle double"), "placed")
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
    files = F.ceil(F.col("n") / FILE_ROWS).cast("int")
    known = counts.select("cell", "n", "widest", files.alias("files"))  # a row a cell, at most MOST_CELLS
    spark = rows.sparkSession
    centre = spark.createDataFrame([(j, [float(y) for y in c]) for j, c in enumerate(centres)], "cell int, centre array<double>")
    known.join(centre, "cell").coalesce(1).write.parquet(f"{folder}/cells")
    dealt = placed.join(F.broadcast(known.select("cell", "files")), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("files")).cast("int"))
    # a cell of many rows goes over several tasks and files
    dealt.repartition("cell", "part").select("id", "unit", "part", "cell").write.partitionBy("cell").parquet(f"{folder}/vectors")


    # how many cells a search has to probe is measured, not guessed: by the exact answers of a few rows
    asked = units.where(F.exists("unit", lambda x: x != 0)).orderBy(F.xxhash64(F.lit(23), "id")).limit(TUNING_ROWS).select(F.col("id").alias("qid"), F.col("unit").alias("vector"))
    asked = cut(asked, "tuning")
    exact = search(spark, folder, asked, 10, 1, exact=True, other=True)
    places = _probes(asked, spark.read.parquet(f"{folder}/cells").collect()).select("qid", "cell", "place")
    need = exact.join(placed.select("id", "cell"), "id").join(places, ["qid", "cell"]).agg(F.percentile_approx("place", RECALL, 10_000).alias("place")).head()["place"]
    spark.createDataFrame([(int(need or 0) + 1,)], "probes int").coalesce(1).write.parquet(f"{folder}/tuning")


def _probes(queries: DataFrame, cells: list) -> DataFrame:
    """qid, its unit vector, and every cell with its place by nearness and its bound."""
    numbers = np.array([c.cell for c in cells], np.int32)
    centres, widest = np.array([c.centre for c in cells]), np.array([c.widest for c in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _units(_matrix(batch.column(1)).astype(np.float64))
            near = q @ centres.T if centres.shape[1] == q.shape[1] else np.zeros((len(q), len(cells)))
            bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - widest[None, :] - 1e-7))
            place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
            k = len(cells)
            each = np.repeat(np.arange(len(q)), k)
            units = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * q.shape[1]), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(each)), units.take(pa.array(each)), pa.array(np.tile(numbers, len(q))), pa.array(place.ravel().astype(np.int32)), pa.array(bound.ravel())], ["qid", "unit", "cell", "place", "bound"])

    return queries.mapInArrow(run, f"qid {dict(queries.dtypes)['qid']}, unit array<double>, cell int, place int, bound double")


def _scored(vectors: DataFrame, probes: DataFrame, cells: list, top: int, other: bool, digits: int) -> DataFrame:
    """qid, id, score: of each probed cell's files the best `top` for each query, by blocks of vectors and queries."""
    spark = vectors.sparkSession
    per_cell = {r.cell: r.n for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    sizes = spark.createDataFrame([(c.cell, c.files, max(1, -(-per_cell[c.cell] // QUERY_ROWS))) for c in cells if c.cell in per_cell] or [(-1, 1, 1)], "cell int, files int, groups int")
    left = vectors.where(F.col("cell").isin(*per_cell) if per_cell else F.lit(False)).join(F.broadcast(sizes.select("cell", "groups")), "cell")
    left = left.select("id", F.col("unit"), "cell", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"))
    right = probes.join(F.broadcast(sizes), "cell").select("qid", "unit", "cell", F.explode(F.sequence(F.lit(0), F.col("files") - 1)).alias("part"), F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int").alias("grp"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        names, who = a.column("id").combine_chunks(), b.column("qid").combine_chunks()
        v, q = _matrix(a.column("unit")), _matrix(b.column("unit"))
        ids = np.array(names.to_pylist())
        by_id = np.argsort(ids, kind="stable")
        own = np.array(who.to_pylist())
        rows, cols, values = [], [], []
        for lo in range(0, len(q) if len(v) else 0, 256):
            score = np.round((q[lo : lo + 256] @ v.T if v.shape[1] == q.shape[1] else np.zeros((len(q[lo : lo + 256]), len(v)))), digits)[:, by_id]
            if other:
                score[own[lo : lo + 256][:, None] == ids[by_id][None, :]] = -9.0
            take = np.argsort(-score, axis=1, kind="stable")[:, :top]
            got = np.take_along_axis(score, take, 1)
            real = got > -9
            rows.append((np.arange(lo, lo + len(score))[:, None] + np.zeros_like(take))[real])
            cols.append(by_id[take][real])
            values.append(got[real])
        none = [np.zeros(0, np.int64)]
        return pa.table([who.take(pa.array(np.concatenate(rows or none))), names.take(pa.array(np.concatenate(cols or none))), pa.array(np.concatenate(values or [np.zeros(0)]))], ["qid", "id", "cosine"])

    keys = ["cell", "part", "grp"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"qid {dict(probes.dtypes)['qid']}, id {dict(vectors.dtypes)['id']}, cosine double")


def _top(scored: DataFrame, top: int) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.col("cosine").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)


def search(spark: SparkSession, folder: str, queries: DataFrame, top: int = 10, probes: int | None = None, *, exact: bool = False, other: bool = False, digits: int = DIGITS) -> DataFrame:
    """qid, id, cosine and rank of the best `top` rows of each query (qid, vector); other: rows with the query's own id don't count.

    probes: cells read for each query, as tuned when the index was built unless given.  exact: cells that could still hold a better row are read too.
    digits: of the cosine that count; rows that agree in them tie, and the smaller id goes first.
    """
    cells = spark.read.parquet(f"{folder}/cells").collect()  # at most MOST_CELLS rows
    vectors = spark.read.parquet(f"{folder}/vectors")
    probes = probes or spark.read.parquet(f"{folder}/tuning").head()["probes"]
    asked = queries.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).select("qid", F.transform("vector", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("vector"))
    every = cut(_probes(asked, cells), "probes")
    found = cut(_top(_scored(vectors, every.where(F.col("place") < probes), cells, top, other, digits), top), "found")
    if not exact:
        return found
    kth = found.where(F.col("rank") == top).select("qid", F.col("cosine").alias("kth"))  # none where fewer were found: all cells count
    more = cut(every.where(F.col("place") >= probes).join(kth, "qid", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 10.0**-digits)).select("qid", "unit", "cell"), "more-probes")
    return _top(found.select("qid", "id", "cosine").unionAll(_scored(vectors, more, cells, top, other, digits)), top)


def similarity(cosine: Column) -> Column:
    """A cosine as a score in [0, 1]."""
    return (cosine + 1) / 2
