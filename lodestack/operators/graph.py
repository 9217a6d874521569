"""Typed edges: neighbour joins, link resolution and bounded expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def backlinks(edges: DataFrame, target: int) -> DataFrame:
    return edges.filter(F.col("dst") == target)


def broken(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target isn't a node."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, direction: str = "both", opaque: DataFrame | None = None) -> DataFrame:
    """Nodes within one or two hops of the seeds (column seed) along pure directions; the best trace of each node.

    Traces order by hop, seed, edge type, forward before backward, role (edges may have a column rel; none comes first). Seeds are left
    out. A node of `opaque` (column id) counts only where another than those leads to it, by any trace. The loop is over hops (at most
    2), so the plan stays finite; all steps are joins on the node.
    """
    if hops not in (1, 2):
        raise ValueError("hops is 1 or 2")
    sides = {"forward": ["f"], "backward": ["b"], "both": ["f", "b"]}[direction]
    role = F.coalesce("rel", F.lit("")) if "rel" in edges.columns else F.lit("")
    found = None
    for side in sides:
        here, there = ("src", "dst") if side == "f" else ("dst", "src")
        step = edges.select(F.col(here).alias("at"), F.col(there).alias("node"), "type", role.alias("rel"))
        now = seeds.select(F.col("seed").alias("at"), F.col("seed"))
        for hop in range(1, hops + 1):
            now = now.join(step, "at").select("seed", "node", "type", "rel", F.col("at").alias("via")).distinct()
            rows = now.select("node", "via", F.struct(F.lit(hop).alias("hop"), "seed", "type", F.lit(sides.index(side) if len(sides) > 1 else 0).alias("turn"), "rel").alias("trace"))
            found = rows if found is None else found.unionByName(rows)
            now = now.select(F.col("node").alias("at"), "seed").distinct()
    if opaque is not None:
        hidden = lambda c: opaque.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_hidden")).distinct()
        found = found.join(hidden("node"), "node", "left").join(hidden("via"), "via", "left")
        found = found.filter(F.col("node_hidden").isNull() | F.col("via_hidden").isNull())
    best = found.join(seeds.select(F.col("seed").alias("node")), "node", "left_anti").groupBy("node").agg(F.min("trace").alias("t"))
    return best.select("node", F.col("t.hop").alias("hop"), F.col("t.seed").alias("seed"), F.col("t.type").alias("type"), F.nullif(F.col("t.rel"), F.lit("")).alias("rel"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (column id)."""
    src, dst = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi")
