"""Centroid clustering: exact Lloyd rounds by a dual-tree search.

Vectors are made integers, floor(scale * x), and cut into blocks; each block is ordered by a cover tree (a node's
descendants lie within twice its children's scale, its children are more than that scale apart, and the first child has
the node's own centre) and stored.  A round sends only the centroids: each task builds a cover tree over them and walks
both trees at once.  A pair of nodes is pruned when its least possible distance exceeds the largest distance that the
vectors of the node can have to some other centroid; a node left with one centroid is assigned whole, by the difference
of two running sums; the rest is compared exactly in the leaves.  Tasks return one sum for each centroid and
component, which Spark adds as decimals; the driver sees that many rows a round, whatever the input.  Bounds are rounded outwards and
prune only what is strictly farther, so ties are settled in the leaves, by the smaller number.

Defined cases: vectors that are null, of another length or with a null or non-finite component are passed over; a null id
is assigned but never a start; repeated rows are vectors of their own, and as starts ordered by their components; with
fewer than `k` vectors with an id there are as many centroids, and without any no rows; an empty centroid stays where it is; components are exact at any size,
and distances and inertias that pass 64 bits are given as the largest 64-bit number; columns other than the id and the
vector are passed over, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import stored

#: Vectors of one tree, and of one leaf.
BLOCK, LEAF = 1024, 8
#: Sums travel as digits of this base, so that a decimal holds them for any number of rows.
LIMB = 1 << 60
LARGEST = (1 << 63) - 1

_NODES = ("centre", "lo", "hi", "first", "last")  # rows by order; children first..last, none in a leaf
_TREES = "ids array<string>, kind string, data binary, nodes array<array<int>>, radius array<double>, starts array<struct<hash: string, vector: array<string>>>"


def _magnitude(*parts: np.ndarray) -> int:
    return max((max(abs(int(p.max())), abs(int(p.min()))) for p in parts if p.size), default=0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices, row by row."""
    top, d = _magnitude(x, y), max(1, x.shape[-1])
    if d * 4 * top * top >= 1 << 62:
        x, y = x.astype(object), y.astype(object)
    diff = x - y
    return (diff * diff).sum(-1)


def _all_squared(x: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of one block, by matrix products where doubles are exact."""
    top, d = _magnitude(x), max(1, x.shape[1])
    if d * 4 * top * top >= 1 << 52:
        return np.stack([squared(x, row[None, :]) for row in x])
    f = x.astype(np.float64)
    norm = (f * f).sum(1)
    return (norm[:, None] + norm[None, :] - 2 * (f @ f.T)).astype(np.int64)


def _root(values: np.ndarray) -> np.ndarray:
    if values.dtype == object:  # whole roots, as squares may pass the range of doubles; one more, so as not to be too small
        return np.array([float(math.isqrt(int(y)) + (y > 0)) for y in values.ravel()]).reshape(values.shape)
    return np.sqrt(values.astype(np.float64))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """The rows in tree order, the nodes level by level, and their radii (never too small)."""
    dist = _root(_all_squared(x))
    order = np.arange(len(x))
    nodes: list[list[int]] = [[0, 0, len(x), 0, 0]]
    radius = [float(dist[0].max(initial=0.0)) * (1 + 1e-12)]
    at = 0
    while at < len(nodes):
        centre, lo, hi, _, _ = nodes[at]
        rows = order[lo:hi]
        if hi - lo > leaf and radius[at] > 0:
            scale = 2.0 ** (math.ceil(math.log2(radius[at])) - 1)
            scale /= 1 if scale < radius[at] / (1 + 1e-11) else 2  # the farthest row always leaves the centre
            groups, rest, head = [], rows, order[centre]
            while len(rest):
                near = dist[head, rest] <= scale
                members = rest[near]
                groups.append((head, members))
                rest = rest[~near]
                head = rest[0] if len(rest) else head
            nodes[at][3:] = [len(nodes), len(nodes) + len(groups)]
            order[lo:hi] = np.concatenate([g for _, g in groups])
            for head, members in groups:
                place = lo + int(np.flatnonzero(members == head)[0])
                nodes.append([place, lo, lo + len(members), 0, 0])
                radius.append(float(dist[head, members].max()) * (1 + 1e-12))
                lo += len(members)
        at += 1
    table = np.array(nodes, np.int64).reshape(-1, 5)
    tree = dict(zip(_NODES, table.T))
    for at in np.flatnonzero(tree["last"] > tree["first"])[::-1]:  # later splits moved the centre's row: the first child, which has the same centre, knows where
        tree["centre"][at] = tree["centre"][tree["first"][at]]
    return order, tree, np.array(radius)


def nearest(x: np.ndarray, tree: dict[str, np.ndarray], radius: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row (in tree order), by walking the two trees together."""
    place, ctree, cradius = cover_tree(centroids, 1)
    out = np.full(len(x), -1, np.int64)
    if not len(x):
        return out
    number = np.array([int(place[lo:hi].min()) for lo, hi in zip(ctree["lo"], ctree["hi"])])  # of equal centroids the smallest
    c_leaf, v_leaf = ctree["last"] == ctree["first"], tree["last"] == tree["first"]
    ordered = centroids[place]
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        dist = _root(squared(x[tree["centre"][v]], ordered[ctree["centre"][c]]))
        heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.append(heads, len(v)))
        upper = np.repeat(np.minimum.reduceat(dist, heads), size) + radius[v]
        keep = dist - radius[v] - cradius[c] <= upper * (1 + 1e-9) + 2
        v, c = v[keep], c[keep]
        heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.append(heads, len(v)))
        settled = np.repeat(np.logical_and.reduceat(c_leaf[c], heads), size)
        alone = settled & np.repeat(size == 1, size)
        for node, cluster in zip(v[alone], number[c[alone]]):
            out[tree["lo"][node] : tree["hi"][node]] = cluster
        compare = settled & ~alone & v_leaf[v]
        if compare.any():
            nodes, numbers = v[compare], number[c[compare]]
            n = tree["hi"][nodes] - tree["lo"][nodes]
            rows = np.repeat(tree["lo"][nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            numbers = np.repeat(numbers, n)
            exact = squared(x[rows], centroids[numbers])
            first = np.lexsort((numbers, exact, rows))
            rows = rows[first]
            best = np.concatenate([[True], rows[1:] != rows[:-1]])
            out[rows[best]] = numbers[first][best]
        split_v = settled & ~alone & ~v_leaf[v]
        split_c = ~settled & ~c_leaf[c]
        same = ~settled & c_leaf[c]
        more_v, more_c = _children(v[split_v], c[split_v], tree)
        less_c, less_v = _children(c[split_c], v[split_c], ctree)
        v, c = np.concatenate([more_v, less_v, v[same]]), np.concatenate([more_c, less_c, c[same]])
        by = np.argsort(v, kind="stable")
        v, c = v[by], c[by]
    return out


def _children(parent: np.ndarray, other: np.ndarray, tree: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = tree["last"][parent] - tree["first"][parent]
    return np.repeat(tree["first"][parent], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(other, n)


# --- blocks -------------------------------------------------------------------------------------------------------


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[scale * a // b for a, b in (float(y).as_integer_ratio() for y in row)] for row in values], object).reshape(values.shape)


def _vectors(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and components of the vectors that count."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy()
    right = (np.diff(offs) == dimensions) & ~np.asarray(column.is_null())
    rows = np.flatnonzero(right)
    values = column.values.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    found = values[offs[:-1][rows][:, None] + np.arange(dimensions)].reshape(-1, dimensions)
    finite = np.isfinite(found).all(1)
    return rows[finite], found[finite]


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", ",".join(map(str, x.ravel().tolist())).encode()
    top = _magnitude(x)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, dimensions: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(y) for y in data.split(b",")], object).reshape(-1, dimensions)
    return np.frombuffer(data, kind).astype(np.int64).reshape(-1, dimensions)


def _plant(dimensions: int, scale: int, seed: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = _vectors(batch.column(1), dimensions)
            names = batch.column(0).take(pa.array(rows)).to_pylist()
            for lo in range(0, len(rows), BLOCK):
                x, ids = _whole(values[lo : lo + BLOCK], scale), names[lo : lo + BLOCK]
                order, tree, radius = cover_tree(x)
                hashes = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), list(map(int, x[at]))) for at, i in enumerate(ids) if i is not None)[:k]
                kind, data = _packed(x[order])
                row = {"ids": [ids[i] for i in order], "kind": kind, "data": data, "nodes": [tree[name].tolist() for name in _NODES], "radius": radius.tolist(),
                       "starts": [{"hash": h, "vector": list(map(str, y))} for h, y in hashes]}
                yield pa.RecordBatch.from_pylist([row], schema=_schema())

    return run


def _schema() -> pa.Schema:
    start = pa.struct([("hash", pa.string()), ("vector", pa.list_(pa.string()))])
    return pa.schema([("ids", pa.list_(pa.string())), ("kind", pa.string()), ("data", pa.binary()), ("nodes", pa.list_(pa.list_(pa.int32()))), ("radius", pa.list_(pa.float64())), ("starts", pa.list_(start))])


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int):
    for batch in batches:
        for row in batch.to_pylist():
            tree = {name: np.array(part, np.int64) for name, part in zip(_NODES, row["nodes"])}
            yield row.get("ids"), _unpacked(row["kind"], row["data"], dimensions), tree, np.array(row["radius"])


def _sums(centroids: list[list[int]], dimensions: int):
    """One row for each centroid, component and digit: vectors and sums of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = len(centroids), _matrix(centroids, dimensions)
        count, total = [0] * k, [[0] * dimensions for _ in range(k)]
        for _, x, tree, radius in _blocks(batches, dimensions):
            cluster = nearest(x, tree, radius, c)
            wide = x.astype(object) if _magnitude(x) >= 1 << 50 else x
            for j in np.unique(cluster).tolist():
                mine = cluster == j
                count[j] += int(mine.sum())
                total[j] = [a + int(b) for a, b in zip(total[j], wide[mine].sum(0))]
        out: list[tuple[int, int, int, int, Decimal]] = []
        for j in range(k):
            for i, y in enumerate(total[j] if count[j] else ()):
                sign, left, digit = -1 if y < 0 else 1, abs(y), 0
                while left or not digit:
                    left, part = divmod(left, LIMB)
                    out.append((j, i, digit, count[j] if not digit else 0, Decimal(sign * part)))
                    digit += 1
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["cluster", "i", "digit", "n", "total"])

    return run


def _matrix(rows: list[list[int]], dimensions: int) -> np.ndarray:
    big = any(abs(y) >= 1 << 62 for row in rows for y in row)
    return np.array(rows, object if big else np.int64).reshape(len(rows), dimensions)


def _assign(centroids: list[list[int]], dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _matrix(centroids, dimensions)
        for ids, x, tree, radius in _blocks(batches, dimensions):
            cluster = nearest(x, tree, radius, c)
            far = squared(x, c[cluster])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(cluster.astype(np.int32)), pa.array([min(int(y), LARGEST) for y in far], pa.int64())], ["id", "cluster", "distance"])

    return run


def cluster(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3,
) -> DataFrame:
    """One row for each vector that counts: id, cluster, squared distance, inertia of the cluster and of all, digest of the centroid."""
    rows = vectors.select(F.col(vec_id).cast("string").alias("id"), F.col(embedding).alias("vector"))
    trees = stored(rows.mapInArrow(_plant(dimensions, scale, seed, k), _TREES), "trees")
    starts = trees.select(F.explode("starts").alias("s")).select("s.*").orderBy("hash", F.transform("s.vector", lambda y: y.cast("decimal(38,0)"))).limit(k).collect()
    centroids = [[int(y) for y in s["vector"]] for s in starts]
    if not centroids:
        trees = trees.limit(0)
    walked = trees.select("kind", "data", "nodes", "radius")
    sums = "cluster int, i int, digit int, n bigint, total decimal(38,0)"
    for _ in range(rounds if centroids else 0):
        parts = walked.mapInArrow(_sums(centroids, dimensions), sums).groupBy("cluster", "i", "digit").agg(F.sum("n"), F.sum("total")).collect()
        total: dict[tuple[int, int], list[int]] = {}
        for j, i, digit, n, value in parts:
            both = total.setdefault((j, i), [0, 0])
            both[0] += n
            both[1] += int(value) * LIMB**digit
        moved = [[total[j, i][1] // total[j, i][0] if (j, i) in total else y for i, y in enumerate(row)] for j, row in enumerate(centroids)]
        if moved == centroids:  # no later round can change anything
            break
        centroids = moved
    found = stored(trees.select("ids", "kind", "data", "nodes", "radius").mapInArrow(_assign(centroids, dimensions), "id string, cluster int, distance bigint"), "assigned")
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    facts = [(0, "")] if not centroids else [(min(inertia.get(j, 0), LARGEST), hashlib.sha256(",".join(map(str, y)).encode()).hexdigest()) for j, y in enumerate(centroids)]
    pick = lambda at, kind: F.array(*(F.lit(f[at]) for f in facts)).cast(f"array<{kind}>")[F.col("cluster")]
    return found.select(
        F.col("id").cast(vectors.schema[vec_id].dataType).alias("vec_id"), "cluster", "distance", pick(0, "bigint").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), LARGEST)).cast("bigint").alias("inertia"), pick(1, "string").alias("centroid_sha256"))


def oracle_sql(dimensions: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """The same rows in DuckDB, round by round."""
    near = """SELECT row, y, c, d FROM (SELECT v.row, v.y, m.c, list_sum(list_transform(list_zip(v.y, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN {m} m)
      QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1"""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS y FROM embeddings
      WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dimensions})""",
        f"""m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, y) - 1 AS c, y AS m FROM (SELECT sha256('{seed}:' || vec_id) AS h, y FROM v WHERE vec_id IS NOT NULL ORDER BY h, y LIMIT {k}))""",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(m=f'm{r}')})")
        parts.append(f"""m{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.m, m.m) AS m FROM m{r} m LEFT JOIN (SELECT c, list(f ORDER BY i) AS m FROM (
      SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f FROM (SELECT c, unnest(y) AS x, unnest(range({dimensions})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n USING (c))""")
    parts.append(f"z AS MATERIALIZED ({near.format(m=f'm{rounds}')})")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, z.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY z.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
    FROM z JOIN v USING (row) JOIN m{rounds} m ON m.c = z.c"""
