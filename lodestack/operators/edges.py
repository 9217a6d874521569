"""Typed edges: their union, choice, freshness, and clusters around seeds. An edge has src, dst, target, type, rel, line."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators import communities, graph

#: The kinds of edges, and how many types and titles a cluster is described by.
KINDS = ("wikilink", "mention", "frontmatter-ref", "hyperlink")
TOP_TYPES, TOP_TITLES = 5, 3
COLUMNS = ("src", "dst", "target", "type", "rel", "line")


def union(*parts: DataFrame) -> DataFrame:
    """All edges of the extractors, each once: rows that differ in none of the columns are one edge, nulls counting as equal."""
    rows = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])
    return rows.dropDuplicates(list(COLUMNS))


def chosen(edges: DataFrame, types: Sequence[str] | None = None, roles: Sequence[str] | None = None) -> DataFrame:
    """Edges of these types and roles; None takes all, an empty list none."""
    for column, wanted in (("type", types), ("rel", roles)):
        if wanted is not None:
            edges = edges.filter(F.col(column).isin(*wanted) if wanted else F.lit(False))
    return edges


def in_order(edges: DataFrame, limit: int) -> DataFrame:
    """The first edges by source, target, type, role and line, missing ones first."""
    return edges.orderBy(*[F.asc_nulls_first(c) for c in ("src", "dst", "type", "rel", "line")]).limit(limit)


def fresh(edges: DataFrame, indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Edges with `stale`: true for one with a role whose declaring note (id, hash) has changed, or gone, since it was indexed."""
    was, now = indexed.select(F.col("id").alias("src"), F.col("hash").alias("was")), current.select(F.col("id").alias("src"), F.col("hash").alias("now"))
    out = edges.join(was, "src", "left").join(now, "src", "left")
    return out.withColumn("stale", F.col("rel").isNotNull() & ~F.coalesce(F.col("was") == F.col("now"), F.lit(False))).drop("was", "now")


def around(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id: the seeds (column seed) and the nodes one edge away in either direction, each once."""
    s = seeds.select(F.col("seed").alias("id")).distinct()
    ahead = edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return s.unionByName(ahead).unionByName(back).filter("id is not null").distinct()


def simple(edges: DataFrame) -> DataFrame:
    """a < b: each pair of linked nodes once, without loops and directions."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def cluster(edges: DataFrame, seeds: DataFrame, *, limit: int = 5000, force: bool = False) -> DataFrame:
    """node, cluster of the graph around the seeds; nodes without an edge are clusters of their own. Over `limit` nodes it must be forced."""
    nodes = around(edges, seeds)
    n = 0 if force else nodes.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} nodes; narrow the seeds or force it")
    inner = simple(graph.induced(edges, nodes)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = communities.louvain(inner)
    return nodes.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster")).orderBy("cluster", "node")


def seeds_of(*, seeds: DataFrame | None = None, asked: str | None = None, search: Callable[[str | None, str, int], DataFrame] | None = None, vaults: Sequence[str] = (), vault: str | None = None, top: int = 10) -> DataFrame:
    """seed: given ones, or the nodes (column node) that a search of one vault finds; one of both has to be given, not both.

    Where there are several vaults, a search has to name one of them; the only one is meant else.
    """
    if (seeds is None) == (asked is None):
        raise ValueError("both_seeds_and_query: give exactly one of seeds and a query")
    if seeds is not None:
        return seeds.select("seed").distinct()
    if vault is None and len(vaults) == 1:
        vault = vaults[0]
    if (vault is None and len(vaults) > 1) or (vault is not None and vault not in vaults):
        raise ValueError(f"vault_required: name one of {', '.join(vaults)}")
    return search(vault, asked, top).select(F.col("node").alias("seed")).distinct()


def summaries(clusters: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """cluster, size, density, types, titles: of the members (node, cluster) with notes (id, title, type).

    Density is the share of pairs that are linked; types the five most frequent, titles the three with most links inside.
    """
    side = lambda c: clusters.select(F.col("node").alias(c), F.col("cluster").alias(f"{c}_cluster"))
    inside = simple(edges).join(side("a"), "a").join(side("b"), "b").filter("a_cluster = b_cluster")
    degree = inside.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    links = inside.groupBy(F.col("a_cluster").alias("cluster")).agg(F.count("*").alias("links"))
    member = clusters.join(notes.select(F.col("id").alias("node"), "title", F.col("type").alias("kind")), "node", "left").join(degree, "node", "left")
    sizes = member.groupBy("cluster").agg(F.count("*").alias("size"))
    kinds = member.filter("kind is not null").groupBy("cluster", "kind").agg(F.count("*").alias("n"))
    types = best(kinds, TOP_TYPES, [F.desc("n"), F.asc("kind")], F.struct("kind", "n"), "types")
    titles = best(member.withColumn("degree", F.coalesce("degree", F.lit(0))), TOP_TITLES, [F.desc("degree"), F.asc("node")], F.struct("title", "degree"), "titles")
    pairs = F.col("size") * (F.col("size") - 1) / 2.0
    out = sizes.join(links, "cluster", "left").join(types, "cluster", "left").join(titles, "cluster", "left")
    return out.select("cluster", "size", F.round(F.when(F.col("size") > 1, F.coalesce("links", F.lit(0)) / pairs).otherwise(0.0), 9).alias("density"), "types", "titles")


def best(rows: DataFrame, n: int, order: list[Column], what: Column, name: str) -> DataFrame:
    """cluster, name: its first n rows as an array, in order; n bounds what is gathered."""
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(*order))
    first = rows.withColumn("place", place).filter(F.col("place") <= n)
    return first.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", what.alias("w")))), lambda x: x["w"]).alias(name))
