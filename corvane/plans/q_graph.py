"""Bounded expansion, links and subgraphs over links between orders of the same part."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import graph
from corvane.plans.catalogue import register
from corvane.session import cut, table

RELATIONS = ("follows", "shared_entity", "contradicts", "updates", "other")
#: Each order and the next one of the same part; the relation and the weight follow the part.
LINKS = """op AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
links AS (SELECT src, dst, CASE p % 5 WHEN 0 THEN 'follows' WHEN 1 THEN 'shared_entity' WHEN 2 THEN 'contradicts' WHEN 3 THEN 'updates' ELSE 'other' END AS relation, round(0.3 + (p % 7) / 10, 2)::DOUBLE AS weight
FROM (SELECT l_orderkey AS src, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS dst, l_partkey AS p FROM op) WHERE dst IS NOT NULL),
owned AS (SELECT o_orderkey AS node FROM orders WHERE o_custkey % 3 <> 0)"""


def links(spark, d):
    p = F.col("l_partkey")
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    nxt = pairs.select(F.col("l_orderkey").alias("src"), F.lead("l_orderkey").over(W.partitionBy("l_partkey").orderBy("l_orderkey")).alias("dst"), "l_partkey").where("dst IS NOT NULL")
    relation = F.element_at(F.array(*map(F.lit, RELATIONS)), (p % 5 + 1).cast("int"))
    return cut(nxt.select("src", "dst", relation.alias("relation"), F.round(0.3 + (p % 7) / 10, 2).alias("weight")), "links")  # every hop reads them


def owned(spark, d):
    return table(spark, d, "orders").where("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("node"))


def _expand_sql(hops: int = 4, max_nodes: int = 40, hop_edges: int = 400) -> str:
    parts = [f"WITH {LINKS}", "f0 AS MATERIALIZED (SELECT o_orderkey AS node, 1.0::DOUBLE AS score FROM orders WHERE o_custkey % 3 <> 0 ORDER BY 1 LIMIT 10)", "u0 AS (SELECT node FROM f0)", "g0 AS (SELECT node, score, 0 AS hop FROM f0 WHERE false)"]
    followed = ", ".join(f"'{r}'" for r in graph.FOLLOWED)
    for d in range(1, hops + 1):
        parts += [
            f"""r{d} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight DESC, node, src, dst, relation) AS rn FROM (SELECT node, parent, src, dst, relation, max(weight) AS weight FROM (
            SELECT l.dst AS node, l.src AS parent, l.* FROM links l JOIN f{d - 1} f ON l.src = f.node UNION ALL SELECT l.src, l.dst, l.* FROM links l JOIN f{d - 1} f ON l.dst = f.node)
            WHERE relation IN ({followed}) AND node IN (SELECT node FROM owned) GROUP BY 1, 2, 3, 4, 5) QUALIFY rn <= {hop_edges})""",
            f"""n{d} AS (SELECT r.node, min(rn) AS place, max(f.score * weight * {0.5 ** (d - 1)} * CASE WHEN relation = 'contradicts' THEN 0.5 ELSE 1 END) AS score FROM r{d} r JOIN f{d - 1} f ON r.parent = f.node WHERE src <> dst GROUP BY 1)""",
            f"""a{d} AS MATERIALIZED (SELECT node, score FROM n{d} WHERE node IN (SELECT node FROM g{d - 1}) UNION ALL (SELECT node, score FROM n{d} WHERE node NOT IN (SELECT node FROM g{d - 1}) ORDER BY place LIMIT greatest(0, {max_nodes} - (SELECT count(*) FROM g{d - 1}))))""",
            f"g{d} AS MATERIALIZED (SELECT node, max(score) AS score, min(hop) AS hop FROM (SELECT * FROM g{d - 1} UNION ALL SELECT node, score, {d} FROM a{d}) GROUP BY 1)",
            f"f{d} AS MATERIALIZED (SELECT node, score FROM a{d} WHERE node NOT IN (SELECT node FROM u{d - 1}))",
            f"u{d} AS MATERIALIZED (SELECT node FROM u{d - 1} UNION SELECT node FROM f{d})",
        ]
    return ", ".join(parts) + f" SELECT node, hop, round(CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END, 6)::DOUBLE AS score FROM g{hops}"


@register("g1_bounded_expansion", _expand_sql())
def g1_bounded(spark, d):
    """Four hops from the tenant's first ten orders: 400 links a hop, 40 nodes, followed relations, rows of the tenant only."""
    rows = owned(spark, d)
    seeds = [r.node for r in rows.orderBy("node").limit(10).collect()]
    return graph.bounded_expand(links(spark, d), seeds, allowed=rows).select("node", "hop", F.round("score", 6).alias("score"))


@register("g5_links", f"""WITH RECURSIVE {LINKS}, first AS (SELECT min(src) AS node FROM links), reach AS (SELECT node, 0 AS hop FROM first UNION SELECT l.dst, hop + 1 FROM reach r JOIN links l ON l.src = r.node WHERE hop < 3 AND relation = 'follows'),
least AS (SELECT node, min(hop) AS hop FROM reach GROUP BY 1) SELECT src, dst, relation, weight, (hop + 1)::INTEGER AS hop FROM links l JOIN least r ON l.src = r.node WHERE hop < 3 AND relation = 'follows' AND src IN (SELECT node FROM owned) AND dst IN (SELECT node FROM owned)""")
def g5(spark, d):
    """Links of one relation within three hops of the first order, both ends of the tenant's."""
    found = links(spark, d)
    return graph.links_of(found, found.agg(F.min("src")).head()[0], 3, relation="follows", owned=owned(spark, d))


_SUB = f"""WITH {LINKS}, ent AS (SELECT p_name AS name, l_orderkey AS node FROM op JOIN part ON p_partkey = l_partkey JOIN owned ON node = l_orderkey), pick AS (SELECT min(p_name) AS name FROM part),
h0 AS MATERIALIZED (SELECT DISTINCT node FROM ent JOIN pick USING (name) ORDER BY node LIMIT 50),
h1 AS MATERIALIZED (SELECT DISTINCT node FROM (SELECT dst AS node FROM links WHERE src IN (SELECT node FROM h0) UNION ALL SELECT src FROM links WHERE dst IN (SELECT node FROM h0)) WHERE node NOT IN (SELECT node FROM h0) ORDER BY node LIMIT 100 - (SELECT count(*) FROM h0)),
s1 AS (SELECT node FROM h0 UNION SELECT node FROM h1 WHERE (SELECT count(*) FROM h0) + (SELECT count(*) FROM h1) < 100)"""


@register("g6_subgraph_edges", f"{_SUB} SELECT src, dst, relation, weight FROM links WHERE src IN (SELECT node FROM s1) OR dst IN (SELECT node FROM s1) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY relation, weight DESC) = 1")
def g6(spark, d):
    """Edges of the subgraph, two hops around the orders of the part with the first name."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    entities = parts.join(lines, F.col("p_partkey") == F.col("l_partkey")).select("name", F.col("l_orderkey").alias("node"))
    return graph.subgraph(links(spark, d), entities, parts.agg(F.min("name")).head()[0], 2, owned=owned(spark, d))[1]
