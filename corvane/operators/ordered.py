"""Rules that depend on the order of rows, without a task that holds a whole group: M4 by rounds, W10 by an associative scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.similarity import set_pairs
from corvane.session import cut

# --- M4 -----------------------------------------------------------------------------------------------------------

#: So few open edges are settled in one pass; more go through rounds.
LAST_EDGES = 100_000


def _last_pass(edges: DataFrame) -> DataFrame:
    """Nodes of at most LAST_EDGES edges (src before dst, with their order) that stay, settled in order."""

    def run(table: pa.Table) -> pa.Table:
        into: dict = {}
        order: dict = {}
        for src, dst, a, b in zip(*(table.column(c).to_pylist() for c in ("src", "dst", "src_order", "dst_order"))):
            into.setdefault(dst, []).append(src)
            order[src], order[dst] = tuple(a.values()), tuple(b.values())
        kept: set = set()
        for node in sorted(order, key=order.get):
            if not any(x in kept for x in into.get(node, ())):
                kept.add(node)
        return pa.table({"node": pa.array(sorted(kept), table.schema.field("src").type)})

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, f"node {dict(edges.dtypes)['src']}")


def _staying(nodes: DataFrame, edges: DataFrame, last_edges: int) -> DataFrame:
    """The nodes that no earlier staying node is linked with; edges: src, dst and their orders, src before dst.

    A node stays once all earlier neighbours are known to go, and goes once one is known to stay; each round settles every
    node for which that is known, in all groups at once, so rounds follow the longest chain of open nodes and not the
    number of rows.  What is left at the end, if it is little, is settled in one bounded pass.
    """
    kept = nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    parts, open_ = [], edges
    fresh = cut(kept, "staying")
    parts.append(fresh)
    while True:
        gone = open_.join(fresh.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        settled = cut(gone.unionAll(fresh), "settled")
        left = open_
        for end in ("src", "dst"):
            left = left.join(settled.select(F.col("node").alias(end)), end, "left_anti")
        was = cut(open_.select(F.col("dst").alias("node")).distinct().join(settled, "node", "left_anti"), "open-nodes")
        open_ = cut(left.select("src", "dst", "src_order", "dst_order"), "open-edges")
        free = was.join(open_.select(F.col("dst").alias("node")), "node", "left_anti")  # all their earlier neighbours have gone
        n = open_.count()
        if n <= last_edges:
            # nodes at the start of an open edge stay in any case if nothing leads to them
            alone = cut(free.join(open_.select(F.col("src").alias("node")), "node", "left_anti"), "staying")
            parts.append(alone)
            if n:
                parts.append(cut(_last_pass(open_), "staying"))
            break
        fresh = cut(free, "staying")
        parts.append(fresh)
    out = parts[0].select("node")
    for part in parts[1:]:
        out = out.unionAll(part.select("node"))
    return out


def merge_facts(facts: DataFrame, threshold: float = 0.3, last_edges: int = LAST_EDGES) -> DataFrame:
    """M4: in time order, a fact joins the earlier unmerged fact of its project and type with the best Jaccard similarity, if it reaches the threshold.

    facts: fact_id (distinct), project, fact_type, created_at, tokens.  Of equal similarities the earliest fact wins.  Facts
    with equal tokens are one node; similar nodes are found by a join on rare tokens, and who stays unmerged is settled in
    rounds over these links, so neither a group nor a key is ever in one task.
    """
    order = F.struct("created_at", "fact_id")
    group = F.to_json(F.struct("project", "fact_type"))
    rows = cut(facts.select("fact_id", "created_at", group.alias("_group"), F.array_sort(F.array_distinct("tokens")).alias("_set")), "facts")
    rows = rows.withColumns({"_h1": F.xxhash64("_set"), "_h2": F.xxhash64(F.lit(7), "_set"), "_order": order})
    same = ["_group", "_h1", "_h2"]
    folded = cut(rows.where(F.size("_set") > 0).groupBy(*same).agg(F.min("_order").alias("_order"), F.any_value("_set").alias("_set")).withColumn("_rep", F.col("_order.fact_id")), "fact-sets")
    pairs = cut(set_pairs(folded.select("_rep", "_group", "_set"), ["_group"], threshold), "similar")
    at = lambda r, o: folded.select(F.col("_rep").alias(r), F.col("_order").alias(o))
    both = cut(pairs.join(at("a_rep", "_a"), "a_rep").join(at("b_rep", "_b"), "b_rep"), "similar-ordered")
    early = F.col("_a") < F.col("_b")
    pick = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    edges = cut(both.select(pick("a_rep", "b_rep").alias("src"), pick("b_rep", "a_rep").alias("dst"), pick("_a", "_b").alias("src_order"), pick("_b", "_a").alias("dst_order")), "edges")
    stay = cut(_staying(folded.select(F.col("_rep").alias("node")), edges, last_edges), "unmerged").withColumnRenamed("node", "_into").join(at("_into", "_into_order"), "_into")
    near = both.select(F.col("a_rep").alias("_rep"), F.col("b_rep").alias("_into"), "jaccard").unionAll(both.select(F.col("b_rep").alias("_rep"), F.col("a_rep").alias("_into"), "jaccard")).unionAll(folded.select("_rep", F.col("_rep").alias("_into"), F.lit(1.0).alias("jaccard")))
    targets = cut(near.join(stay, "_into"), "targets")
    members = rows.join(folded.select(*same, "_rep"), same).select("fact_id", "_order", "_rep")
    met = members.join(targets, "_rep").where(F.col("_into_order") < F.col("_order"))
    best = met.groupBy("fact_id").agg(F.min_by("_into", F.struct((-F.col("jaccard")).alias("j"), "_into_order")).alias("merged_into"))
    return facts.select("fact_id").join(best, "fact_id", "left")


# --- W10 ----------------------------------------------------------------------------------------------------------

#: Items of one chunk, and tables put together at a time.
CHUNK, FAN = 4096, 64


def _table(full: np.ndarray, compact: np.ndarray, budget: int) -> np.ndarray:
    """For each number of tokens left before the items, the number left after them."""
    left = np.arange(budget + 1)
    for f, c in zip(full.tolist(), compact.tolist()):
        left = np.where(f <= left, left - f, np.where(c <= left, left - c, left))
    return left


def pack_budget(items: DataFrame, key: str, order: str, full: str, compact: str, budget: int, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Items in order, whole while they fit, else the compact form while that fits, else passed over; per key.

    items: token counts (0 or more) in `full` and `compact`.  Rows are sorted over all tasks and cut into chunks; a chunk is
    a table from tokens left before it to tokens left after it.  Tables are put together level by level, which gives what
    is left at the start of every chunk, and each chunk is then gone through once.  A key may have any number of rows.
    """
    rows = items.select(F.col(key).alias("k"), F.col(order).cast("bigint").alias("o"), F.col(full).cast("bigint").alias("f"), F.col(compact).cast("bigint").alias("c"))
    kind = dict(rows.dtypes)["k"]
    rows = cut(rows, "pack-rows")
    ranged = rows.repartitionByRange("k", "o", "f", "c", F.xxhash64("k", "o", "f", "c")).sortWithinPartitions("k", "o", "f", "c").withColumn("part", F.spark_partition_id())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, last = 0, 0, object()
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                if k != last or size == chunk:
                    number, size, last = number + 1, 0, k
                size += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "chunk"])

    cut_up = cut(ranged.mapInArrow(chunks, f"k {kind}, o bigint, f bigint, c bigint, part int, chunk bigint"), "pack-chunks")

    def tables(group: pa.Table) -> pa.Table:
        group = group.sort_by([("o", "ascending"), ("f", "ascending"), ("c", "ascending")])
        made = _table(group.column("f").to_numpy(), group.column("c").to_numpy(), budget).tolist()
        return pa.table({"k": group.column("k").slice(0, 1), "part": group.column("part").slice(0, 1), "chunk": group.column("chunk").slice(0, 1), "t": pa.array([made], pa.list_(pa.int64()))})

    nodes = cut(cut_up.groupBy("part", "chunk").applyInArrow(tables, f"k {kind}, part int, chunk bigint, t array<bigint>"), "pack-tables")
    place = (F.row_number().over(W.partitionBy("k").orderBy("part", "chunk")) - 1).cast("bigint")  # over chunks, without their tables
    level = cut(nodes.join(nodes.select("k", "part", "chunk").withColumn("at", place).drop("k"), ["part", "chunk"]).select("k", "at", "part", "chunk", "t"), "pack-level")
    levels = [level]

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        made = np.arange(budget + 1)
        for t in group.column("t").to_pylist():
            made = np.array(t)[made]
        return pa.table({"k": group.column("k").slice(0, 1), "at": pa.array([group.column("at")[0].as_py() // fan], pa.int64()), "t": pa.array([made.tolist()], pa.list_(pa.int64()))})

    while (levels[-1].agg(F.max("at")).head()[0] or 0) > 0:
        levels.append(cut(levels[-1].select("k", "at", "t").groupBy("k", F.floor(F.col("at") / fan).alias("_g")).applyInArrow(joined, f"k {kind}, at bigint, t array<bigint>"), "pack-level"))

    def starts(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        left, out = group.column("start")[0].as_py(), []
        for t in group.column("t").to_pylist():
            out.append(left)
            left = t[left]
        return pa.table({"k": group.column("k"), "at": group.column("at"), "start": pa.array(out, pa.int64())})

    start = levels[-1].select("k", "at", F.lit(budget).cast("bigint").alias("start"))
    for lower in reversed(levels[:-1]):
        above = start.select(F.col("k").alias("_k"), F.col("at").alias("_g"), "start")
        same_group = F.col("k").eqNullSafe(F.col("_k")) & (F.floor(F.col("at") / fan) == F.col("_g"))
        with_start = lower.select("k", "at", "t").join(above, same_group).select("k", "at", "t", "_g", "start")
        start = cut(with_start.groupBy("k", "_g").applyInArrow(starts, f"k {kind}, at bigint, start bigint"), "pack-start")
    begins = start.select(F.col("k").alias("_k"), F.col("at").alias("_at"), "start")
    begins = level.select("k", "at", "part", "chunk").join(begins, F.col("k").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at"))).select("part", "chunk", "start")

    def replay(group: pa.Table) -> pa.Table:
        group = group.sort_by([("o", "ascending"), ("f", "ascending"), ("c", "ascending")])
        left, forms, lefts = group.column("start")[0].as_py(), [], []
        for f, c in zip(group.column("f").to_pylist(), group.column("c").to_pylist()):
            forms.append("full" if f <= left else "compact" if c <= left else "skip")
            left -= f if f <= left else c if c <= left else 0
            lefts.append(left)
        return pa.table({"k": group.column("k"), "o": group.column("o"), "form": forms, "left_tokens": pa.array(lefts, pa.int64())})

    packed = cut_up.join(begins, ["part", "chunk"]).groupBy("part", "chunk").applyInArrow(replay, f"k {kind}, o bigint, form string, left_tokens bigint")
    return packed.select(F.col("k").alias(key), F.col("o").alias(order), "form", "left_tokens")
