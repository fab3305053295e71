"""Graph operators over edge lists: bounded hops as joins, signals and work-graph readiness as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut


def expand(edges: DataFrame, seeds: DataFrame, hops: int, decay: float = 0.5, max_nodes: int = 40, checkpoint: bool = True) -> DataFrame:
    """G1: nodes reached from seeds (node, score), each with its best score: parent * weight * decay^(hop - 1).

    edges: src, dst, weight, penalty.  The frontier of each hop is pre-aggregated to one row a node and its lineage cut
    by a checkpoint in the shared folder; seeds are not reached again.
    """
    edges = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), "weight", "penalty")
    seen = seeds.select("node", "score", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(edges, F.col("node") == F.col("_from")).groupBy(F.col("_to").alias("node")).agg(F.max(F.col("score") * F.col("weight") * F.col("penalty") * (decay ** (hop - 1))).alias("score"))
        frontier = step.join(seen.select("node"), "node", "left_anti").select("node", "score", F.lit(hop).alias("hop"))
        if checkpoint and edges.sparkSession.sparkContext.getCheckpointDir():
            frontier = frontier.checkpoint()
        seen = seen.unionAll(frontier)
    return seen.where("hop > 0").orderBy(F.col("score").desc(), "node").limit(max_nodes)


#: Relations that expansion follows, and the one that halves a score.
FOLLOWED = ("shared_entity", "follows", "extends", "derives", "contradicts", "causes", "part_of", "updates", "superseded")
HALVED = "contradicts"


def bounded_expand(links: DataFrame, seeds: list, *, allowed: DataFrame | None = None, hops: int = 4, decay: float = 0.5, max_nodes: int = 40, hop_edges: int = 400) -> DataFrame:
    """G1 in full: node, score (min-max over the nodes found) and the hop at which it was first found.

    links: src, dst, relation, weight; followed both ways.  allowed: node, the rows that filters and tenants let through.
    Of each hop only the `hop_edges` heaviest links of the frontier count (ties by node, src, dst, relation), and once
    `max_nodes` are found no new one is; so a frontier is at most that many nodes, which go to the scan of the links as a list.
    A node passes its best score of a hop on, times weight and decay, once; seeds may be scored but are not passed through again.
    """
    spark = links.sparkSession
    scores: dict = {}
    first: dict = {}
    used = set(seeds)
    frontier = dict.fromkeys(seeds, 1.0)
    known = links.where(F.col("relation").isin(*FOLLOWED))
    for depth in range(1, max(1, min(hops, 5)) + 1):
        if not frontier:
            break
        ahead = known.where(F.col("src").isin(*frontier)).select(F.col("dst").alias("node"), F.col("src").alias("parent"), "src", "dst", "relation", "weight")
        back = known.where(F.col("dst").isin(*frontier)).select(F.col("src").alias("node"), F.col("dst").alias("parent"), "src", "dst", "relation", "weight")
        met = ahead.unionAll(back).groupBy("node", "parent", "src", "dst", "relation").agg(F.max("weight").alias("weight"))
        if allowed is not None:
            met = met.join(allowed.select("node"), "node", "left_semi")
        rows = met.orderBy(F.col("weight").desc(), "node", "src", "dst", "relation").limit(hop_edges).collect()  # bounded
        step: dict = {}
        for r in rows:
            if (len(scores) >= max_nodes and r.node not in scores) or r.src == r.dst or r.weight is None:
                continue
            score = frontier[r.parent] * r.weight * decay ** (depth - 1) * (0.5 if r.relation == HALVED else 1.0)
            scores[r.node] = max(scores.get(r.node, 0.0), score)
            first.setdefault(r.node, depth)
            if r.node not in used:
                step[r.node] = max(step.get(r.node, 0.0), score)
        used.update(step)
        frontier = step
    low, high = min(scores.values(), default=0.0), max(scores.values(), default=0.0)
    found = [(k, 1.0 if high == low else (v - low) / (high - low), first[k]) for k, v in scores.items()]
    kind = dict(links.dtypes)["src"]
    return spark.createDataFrame(found, f"node {kind}, score double, hop int")


def links_of(links: DataFrame, start, depth: int = 1, *, relation: str | None = None, owned: DataFrame | None = None) -> DataFrame:
    """The outgoing links within `depth` (1 to 5) of a node, with the hop at which each was met; owned: node, rows of the tenant.

    Frontiers may be large, so they stay tables: each hop is a join, and its new nodes are stored once.  A link whose ends
    are not both of the tenant's goes at the end, as it may lead to others.
    """
    spark = links.sparkSession
    kept = links if relation is None else links.where(F.col("relation") == relation)
    kind = dict(links.dtypes)["src"]
    seen = frontier = spark.createDataFrame([(start,)], f"node {kind}")
    out = None
    for hop in range(1, max(1, min(depth, 5)) + 1):
        met = cut(kept.join(frontier.withColumnRenamed("node", "src"), "src").select(*links.columns, F.lit(hop).alias("hop")), "links")
        out = met if out is None else out.unionAll(met)
        frontier = cut(met.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    if owned is not None:
        for end in ("src", "dst"):
            out = out.join(owned.select(F.col("node").alias(end)), end, "left_semi")
    return out.select(*links.columns, "hop")


def subgraph(links: DataFrame, entities: DataFrame, name: str, depth: int, *, owned: DataFrame | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, hop) and edges (src, dst, relation, weight) around the rows that carry an entity.

    entities: name, node.  An exact name first; where no row has it, names that contain it.  At most `limit` (100) nodes,
    half of them seeds, the smallest ids first; edges are those met from the frontiers, one for each (src, dst): the
    one with the least relation and the highest weight.
    """
    limit = max(1, min(limit, 100))
    spark = links.sparkSession
    rows = entities if owned is None else entities.join(owned.select("node"), "node", "left_semi")
    pick = lambda which: [r.node for r in rows.where(which).select("node").distinct().orderBy("node").limit(min(50, limit)).collect()]
    seeds = pick(F.col("name") == name) or pick(F.contains("name", F.lit(name)))
    hops, frontier, sources = dict.fromkeys(seeds, 0), seeds, set()
    for hop in range(1, max(1, min(depth, 5)) + 1):
        if not frontier or len(hops) >= limit:
            break
        sources.update(frontier)
        near = links.where(F.col("src").isin(*frontier)).select(F.col("dst").alias("node")).unionAll(links.where(F.col("dst").isin(*frontier)).select(F.col("src").alias("node")))
        fresh = [r.node for r in near.where(~F.col("node").isin(*hops)).distinct().orderBy("node").limit(limit - len(hops)).collect()]  # bounded
        hops.update(dict.fromkeys(fresh, hop))
        frontier = fresh
    kind = dict(links.dtypes)["src"]
    nodes = spark.createDataFrame(list(hops.items()), f"node {kind}, hop int")
    met = links.where(F.col("src").isin(*sources) | F.col("dst").isin(*sources)) if sources else links.limit(0)
    edges = met.groupBy("src", "dst").agg(F.min_by(F.struct("relation", "weight"), F.struct("relation", (-F.col("weight")).alias("w"))).alias("e")).select("src", "dst", "e.relation", "e.weight")
    if owned is not None:
        nodes = nodes.join(owned.select("node"), "node", "left_semi")
    return nodes, edges


def hops_from(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Each node within `hops` of the seeds with its least hop; edges: src, dst."""
    edges = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    seen = seeds.select("node", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(edges, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"))
        seen = seen.unionAll(frontier)
    return seen


def proximity(hop: Column) -> Column:
    return 1.0 / (1 + hop)


# The weight of each kind of relation in the temporal signal.
KIND_WEIGHTS = {"updates": 1.0, "supersedes": 1.0, "superseded": -0.8, "contradicts": -0.5, "contradicted": -0.5, "causes": 0.3, "enables": 0.3, "is_a": 0.2, "depends_on": 0.2}
DEFAULT_KIND_WEIGHT = 0.1


def relation_freshness(now: str, valid_to: str, invalidated_at: str) -> Column:
    """0 for what was invalidated, 1/2 for what ran out, else 1."""
    ended = F.col(valid_to).isNotNull() & (F.col(valid_to) <= F.lit(now).cast("timestamp_ntz"))
    return F.when(F.col(invalidated_at).isNotNull(), 0.0).when(ended, 0.5).otherwise(1.0)


def temporal_signal(relations: DataFrame, node: str, kind: str, strength: str, freshness: Column) -> DataFrame:
    """Sum of kind weight * strength in [0, 1] * freshness, within [-0.5, 1]."""
    weight = None
    for k, v in KIND_WEIGHTS.items():
        weight = F.when(F.col(kind) == k, v) if weight is None else weight.when(F.col(kind) == k, v)
    weight = weight.otherwise(DEFAULT_KIND_WEIGHT)
    part = weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(strength))) * freshness
    return relations.groupBy(node).agg(F.least(F.lit(1.0), F.greatest(F.lit(-0.5), F.sum(part))).alias("signal"))


#: What a relation to another item means for readiness, and whether the other one's being closed lifts it.
REASONS = {"blocks": ("blocked_by", True), "checkpoint": ("checkpoint_waiting", True), "supersedes": ("superseded", False), "duplicates": ("duplicate", False)}


def readiness(items: DataFrame, dependencies: DataFrame, leases: DataFrame) -> DataFrame:
    """Each work item with the codes of what holds it back, and whether nothing does.

    items: work_id, status.  dependencies: from_id, to_id, relation.  leases: work_id (live ones).  A blocker that is
    not among the items counts as open.
    """
    status = items.where("status <> 'planned'").select("work_id", F.lit("status").alias("code"))
    known = dependencies.join(items.select(F.col("work_id").alias("from_id"), F.col("status").alias("from_status")), "from_id", "left")
    code = None
    for relation, (name, lifted) in REASONS.items():
        holds = (F.col("relation") == relation) & (~F.col("from_status").eqNullSafe("closed") if lifted else F.lit(True))
        code = F.when(holds, name) if code is None else code.when(holds, name)
    held = known.select(F.col("to_id").alias("work_id"), code.alias("code")).where("code IS NOT NULL")
    leased = leases.select("work_id", F.lit("leased").alias("code"))
    codes = status.unionAll(held).unionAll(leased).groupBy("work_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))  # six codes at most
    out = items.join(codes, "work_id", "left")
    return out.select("work_id", "status", F.coalesce(F.array_join("codes", ","), F.lit("")).alias("reasons"), F.col("codes").isNull().alias("ready"))


def next_work(items: DataFrame, dependencies: DataFrame, leases: DataFrame, priority: Column, age_hours: Column, session: Column, current_session: str, limit: int = 10) -> DataFrame:
    """The ready items, best first: 8 for each step of priority, 10 for each item they unblock (five count), recency and continuity.

    items: work_id, status and what the Columns need; a null priority is 2.
    """
    ready = readiness(items.select("work_id", "status"), dependencies, leases).where("ready").select("work_id")
    unblocks = dependencies.where("relation = 'blocks'").join(items.where("status <> 'closed'").select(F.col("work_id").alias("to_id")), "to_id").groupBy(F.col("from_id").alias("work_id")).agg(F.count("*").alias("unblocks"))
    score_p = 8 * F.least(F.lit(5), F.greatest(F.lit(0), 5 - F.coalesce(priority, F.lit(2))))
    score_b = 10 * F.least(F.lit(5), F.coalesce("unblocks", F.lit(0)))
    score_r = F.when(age_hours <= 1, 15).when(age_hours <= 24, 10).when(age_hours <= 168, 5).otherwise(0)
    score_c = F.when(session == current_session, 20).when(session.isNotNull(), 8).otherwise(0)
    scored = items.join(ready, "work_id", "left_semi").join(unblocks, "work_id", "left").select("work_id", score_p.cast("bigint").alias("priority_score"), (score_p + score_b + score_r + score_c).cast("bigint").alias("score"))
    return scored.orderBy(F.col("score").desc(), F.col("priority_score").desc(), "work_id").limit(limit)
