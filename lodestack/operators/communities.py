"""Communities of an undirected graph by modularity: Louvain's levels, each of rounds of simultaneous moves over links in blocks.

A round totals the clusters' degrees, tells the nodes' clusters to the blocks that link to them, weighs each node's moves, and takes the best
(`moves` has the steps; `weighed` tells the same as joins, which tests hold the blocks to). Half of the nodes at most, by a hash of node and round, move in one round, fewer where many want
to join one cluster, and of two single nodes the smaller waits for the larger, so neighbours don't swap places for ever. A level ends when hardly
a node gains by moving, or after `most_rounds`; then links are added up between clusters, which are the next level's nodes. Once a level moves nothing, the clusters are settled on
the nodes themselves by further rounds, since what was contracted early may lie better elsewhere (`modularity` counts nodes that still gain).

A level's links are packed once, by ranges of nodes; a hub's links stay in one block. Graphs of many groups are handled side by side. Each round is written in
the shared folder; only counts of nodes reach the driver.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators import moves
from lodestack.operators.moves import STEP
from lodestack.runtime import ship, stored


def both_ways(edges: DataFrame, group: str | None) -> DataFrame:
    """g, a, b, w: the simple undirected graph, each edge from both ends."""
    g = F.col(group) if group else F.lit(0)
    once = edges.filter("src is not null and dst is not null and src <> dst").select(g.alias("g"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return once.unionByName(once.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("w", F.lit(1.0))


def degrees(links: DataFrame) -> DataFrame:
    """g, node, k, m2: a node's degree and its graph's sum of degrees."""
    k = links.groupBy("g", F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    return k.join(k.groupBy("g").agg(F.sum("k").alias("m2")), "g")


def ready(links: DataFrame, place: DataFrame) -> DataFrame:
    """The links between different nodes, with the degree and the sum of degrees (k, m2) of the node a: the same in all rounds of a level."""
    return links.filter("a <> b").join(place.select("g", F.col("node").alias("a"), "k", "m2"), ["g", "a"])


def totalled(place: DataFrame) -> DataFrame:
    """The places with their clusters' total degrees and sizes (tot, size)."""
    return place.join(place.groupBy("g", "c").agg(F.sum("k").alias("tot"), F.count("*").alias("size")), ["g", "c"])


def weighed(links: DataFrame, known: DataFrame) -> DataFrame:
    """For each node (g, node, k, m2, own) of the totalled places, whose links are ready, what staying is worth, and the best move: stay, best (value, minus the cluster, and whether it waits for the other to come)."""
    linked = links.join(known.select("g", F.col("node").alias("b"), "c", "tot", "size"), ["g", "b"]).select("g", F.col("a").alias("node"), "c", "w", "k", "m2", "tot", "size", F.lit(False).alias("here"))
    # A row of weight 0 for a node's own cluster, so that nodes without links keep a row.
    rows = linked.unionByName(known.select("g", "node", "c", F.lit(0.0).alias("w"), "k", "m2", "tot", "size", F.lit(True).alias("here")))
    each = rows.groupBy("g", "node", "c").agg(F.sum("w").alias("w"), *[F.max(name).alias(name) for name in ("k", "m2", "tot", "size", "here")])
    value = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("here"), F.col("k")).otherwise(0.0)) / F.col("m2")
    steps = F.round(value / STEP).cast("long")
    own = F.when(F.col("here"), F.struct(F.col("c").alias("own"), "size", steps.alias("stay")))
    other = F.when(~F.col("here"), F.struct(steps.alias("value"), (-F.col("c")).alias("minus"), "size"))
    per = each.groupBy("g", "node").agg(F.max("k").alias("k"), F.max("m2").alias("m2"), F.max(own).alias("o"), F.max(other).alias("x"))
    waits = (F.col("o.size") == 1) & (F.col("x.size") == 1) & (-F.col("x.minus") > F.col("o.own"))
    return per.select("g", "node", "k", "m2", "o.own", "o.stay", F.when(F.col("x").isNotNull(), F.struct("x.value", "x.minus", waits.alias("waits"))).alias("best"))


class Blocks:
    """The links of a level (g, a, b, w) in blocks, and the rounds over them."""

    def __init__(self, links: DataFrame) -> None:
        g = links.schema["g"].dataType.simpleString()
        self.parts = max(1, -(-links.count() // moves.LINKS))
        dealt = links.repartitionByRange(self.parts, "g", "a") if self.parts > 1 else links.repartition(1)
        built = stored(dealt.sortWithinPartitions("g", "a").mapInArrow(moves.built, f"{moves.ROWS}, gs array<{g}>, need array<binary>"), "louvain")
        self.names = stored(built.drop("need").mapInArrow(moves.nodes, f"i long, g {g}, node long, k double, part int"), "louvain")
        home, place = F.shiftright("i", 32).cast("int"), F.col("i").bitwiseAND(0xFFFFFFFF).cast("int")
        parts = self.names.groupBy(home.alias("dest"), "part", "g").agg(F.sum("k").alias("k"))
        m2 = parts.join(parts.groupBy("g").agg(F.sum("k").alias("x")), "g").select("dest", F.lit("m2").alias("kind"), F.col("part").alias("at"), "x")
        near = built.select("dest", "gs", "need").mapInArrow(moves.needed, f"to int, slot int, g {g}, node long")
        ways = near.join(self.names, ["g", "node"]).select(home.alias("dest"), F.lit("way").alias("kind"), place.alias("at"), "to", "slot")
        rows = built.drop("need").unionByName(m2, allowMissingColumns=True).unionByName(ways, allowMissingColumns=True)
        self.fixed = stored(self.deal(rows).mapInArrow(moves.packed, f"{moves.ROWS}, gs array<{g}>"), "louvain")
        self.blocks, self.routes = (self.fixed.filter(F.col("kind") == kind) for kind in ("block", "route"))
        self.g = g

    def deal(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionById(self.parts, "dest")

    def step(self, rows: DataFrame, *steps, dealt: bool = True) -> DataFrame:
        return (self.deal(rows) if dealt else rows).mapInArrow(moves.stepping(*steps), moves.ROWS)

    def singles(self) -> DataFrame:
        """The states in which each node is its own cluster."""
        return self.step(self.blocks.drop("gs"), moves.singles, dealt=False)

    def placed(self, of: DataFrame) -> DataFrame:
        """The states in which the nodes i are in the clusters c (both by id), and others are their own cluster."""
        at = of.select(F.shiftright("i", 32).cast("int").alias("dest"), F.lit("at").alias("kind"), "i", "c")
        return self.deal(self.blocks.drop("gs").unionByName(at, allowMissingColumns=True)).mapInArrow(moves.placed, moves.ROWS)

    def named(self, clusters: DataFrame) -> DataFrame:
        """The ids i, c of nodes (g, node) and their clusters, which nodes c name."""
        rows = clusters.join(self.names.select("g", "node", "i"), ["g", "node"]).select("g", "i", F.col("c").alias("name"))
        return rows.join(self.names.select("g", F.col("node").alias("name"), F.col("i").alias("c")), ["g", "name"]).select("i", "c")

    def totalled(self, state: DataFrame, *before, named: bool = False) -> DataFrame:
        """The states with their clusters' totals, after the steps before, and what they tell their neighbours."""
        asked = self.step(state, *before, moves.summed, dealt=bool(before))
        told = partial(moves.told, named=True) if named else moves.told
        return self.step(self.step(asked, moves.totalled).unionByName(self.routes.drop("gs")), told)

    def rounds(self, state: DataFrame, first: int, most: int, rest: float) -> tuple[DataFrame, int]:
        """Rounds until at most the share `rest` of the nodes wants to move; the states and how many rounds it took."""
        if self.parts == 1:
            state = stored(self.step(state.unionByName(self.fixed.drop("gs")), moves.alone(first, most, rest)), "louvain")
            return state, state.agg(F.max("turn")).first()[0] or 0
        before = ()
        for turn in range(most):
            told = self.totalled(state, *before).unionByName(self.blocks.drop("gs"))
            rows = stored(self.step(told, moves.weighed(first + turn)), "louvain")
            states = rows.filter("kind = 'state'")
            n, wanting = states.agg(F.sum("n"), F.sum("wanting")).first()
            if wanting <= rest * n:
                return states, turn
            state, before = self.step(rows, moves.loaded), (moves.moved,)
        return stored(self.step(state, *before, dealt=bool(before)), "louvain"), most

    def joined(self, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links between clusters (g, a, b, w), and the clusters (g, c, up) of the nodes c, by their first nodes."""
        told = self.totalled(state, named=True).unionByName(self.blocks, allowMissingColumns=True)
        rows = stored(self.deal(told).mapInArrow(moves.joined, f"g {self.g}, a long, b long, w double"), "louvain")
        return rows.filter("w is not null").groupBy("g", "a", "b").agg(F.sum("w").alias("w")), rows.filter("w is null").select("g", F.col("a").alias("c"), F.col("b").alias("up"))

    def judged(self, state: DataFrame) -> DataFrame:
        """For each graph of each block what its nodes have in the states' clusters: g, k, inside, apart, share, gainers (see `moves.judged`)."""
        told = self.totalled(state).unionByName(self.blocks, allowMissingColumns=True)
        return self.deal(told).mapInArrow(moves.judged, f"g {self.g}, k double, inside double, apart double, share double, gainers long")


def leveled(edges: DataFrame, group: str | None = None) -> Blocks:
    """The simple undirected graph of edges (src, dst) in blocks, for `louvain` and `modularity` of the same edges."""
    ship(edges.sparkSession)
    return Blocks(stored(both_ways(edges, group).filter("g is not null").select("g", F.col("a").cast("long"), F.col("b").cast("long"), "w"), "louvain"))


def louvain(edges: DataFrame, group: str | None = None, *, most_levels: int = 12, most_rounds: int = 12, settling: int = 12, rest: float = 0.05, level: Blocks | None = None) -> DataFrame:
    """node, cluster (and the group) of the simple undirected graph of edges (src, dst), a graph for each group.

    Nodes are whole numbers, a cluster is named by its smallest one. Loops and nulls are left out; nodes without an edge have no row. The result depends on the
    graph alone, not on its partitions.
    """
    kind = both_ways(edges, group).schema["a"].dataType
    whole = level = level or leveled(edges, group)
    member, turn = None, 0
    for _ in range(most_levels):
        state, used = level.rounds(level.singles(), turn, most_rounds, rest)
        turn += used
        links, to = level.joined(state)
        nodes, clusters = to.agg(F.count("*"), F.countDistinct("g", "up")).first()
        if clusters == nodes:
            break
        member = to.select("g", F.col("c").alias("node"), F.col("up").alias("c")) if member is None else stored(member.join(to, ["g", "c"]).select("g", "node", F.col("up").alias("c")), "louvain")
        level = Blocks(stored(links, "louvain"))
    state, _ = whole.rounds(whole.placed(whole.named(member)) if member is not None else whole.singles(), turn, settling, 0.0)
    at = stored(state.mapInArrow(moves.places, "i long, c long").join(whole.names, "i"), "louvain")
    out = at.join(at.groupBy("c").agg(F.min("node").alias("cluster")), "c").select("g", F.col("node").cast(kind), F.col("cluster").cast(kind))
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def modularity(edges: DataFrame, clusters: DataFrame, group: str | None = None, *, level: Blocks | None = None) -> DataFrame:
    """g, nodes, edges, clusters, modularity, gainers of a partition (node, cluster): gainers are the nodes that would gain by moving alone.

    `nodes` counts those that the partition places; nodes of the graph that it leaves out count as clusters of their own in the rest.
    """
    level = level or leveled(edges, group)
    g = F.col(group) if group else F.lit(0)
    of = stored(clusters.select(g.alias("g"), F.col("node").cast("long"), "cluster").join(level.names, ["g", "node"]).select("g", "i", "cluster"), "louvain")
    first = of.groupBy("g", "cluster").agg(F.min("i").alias("c"))
    each = stored(level.judged(level.placed(of.join(first, ["g", "cluster"]).select("i", "c"))), "louvain")
    sums = each.groupBy("g").agg(
        (F.sum("k") / 2).cast("long").alias("edges"), F.round(F.sum("share")).cast("long").alias("clusters"), F.round(F.sum("inside") / F.sum("k") - F.sum("apart") / F.pow(F.sum("k"), 2), 6).alias("modularity"), F.sum("gainers").alias("gainers")
    )
    return of.groupBy("g").agg(F.count("*").alias("nodes")).join(sums, "g").select("g", "nodes", "edges", "clusters", "modularity", "gainers")
