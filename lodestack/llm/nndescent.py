"""Operator 9, near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node with a weight. Lists of `k` neighbours start in buckets of random-projection signs,
and are refined by joins of neighbours of neighbours: each node's list, forward and reverse, meets in one group, and all
vectors in it are compared. Crowded buckets and lists are split by hash into groups of bounded size, each round by another
hash, so nothing is dropped and no task holds a hot node. A list whose `k` neighbours all link is saturated, and is enlarged
by more that do, `k` each round. Edges at or over the threshold are kept.

Lists hold `k` neighbours at least and all links of a group up to `k`, so a list that may have lost a link lies in a component
of more than `k` nodes, called dense. Dense components leave the refinement and are compared with all other nodes of their label
exactly: their vectors form blocks, each with a centre and an angle around it; a node that no block's angle excludes is multiplied
with that block. At the end links are counted per vector from the blocks of its component, without writing pairs.

Recall of the rest is audited each round: sampled vectors are compared with all vectors of their label, and a vector counts as found
if all its links lie in its component. The sample grows from `audit` vectors to 16 times as many until `audit // 4` of them have links
outside dense components. Rounds go on while less than `min_recall` of those are found; after `max_rounds`, or if the sample is too
poor to judge, all nodes outside dense components are compared exactly, in pairs of blocks. Cosines are computed in double
precision everywhere.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label, link with nothing and
stand alone; vectors of different numbers of components have no cosine and don't link; repeated rows are vectors of their own that
link with each other (rows with equal ids share one component); a null id stays a row of its own with no links and component null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import components, cut_lineage
from lodestack.llm.vectors import matrices, stacked, valid, whole

EDGE = "a long, b long, s double"


def cosines(m: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """m: unit rows."""
    return m @ (m if other is None else other).T


def units(blobs: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that squares neither overflow nor vanish."""
    m = stacked(blobs, "float64")
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def edge_batch(ids: np.ndarray, s: np.ndarray, keep: int, links: int, threshold: float) -> pa.Table:
    """For each row its `keep` best partners, and more up to `links` while they reach the threshold."""
    np.fill_diagonal(s, -2.0)
    n = min(max(keep, links), len(ids) - 1)
    if n < 1:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
    best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(ids) - 1 else np.argsort(-s, axis=1)[:, :n]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1), 1)
    a, rank = np.repeat(np.arange(len(ids)), n), np.tile(np.arange(n), len(ids))
    b = best.ravel()
    wanted = (rank < keep) | (s[a, b] >= threshold)
    a, b = a[wanted], b[wanted]
    return pa.table({"a": ids[a], "b": ids[b], "s": s[a, b]})


def best_lists(edges: DataFrame, k: int, most: int, threshold: float) -> DataFrame:
    """The k best distinct partners of each node; a list that is saturated, whose k-th partner links, holds up to `most` that do."""
    distinct = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    kept = distinct.withColumn("r", rank).filter(F.col("r") <= most)
    return kept.filter((F.col("r") <= k) | (F.col("s") >= threshold)).drop("r")


def meet(left: DataFrame, right: DataFrame, keys: list[str], most: int = 64) -> DataFrame:
    """Each block of the left (numbered by sub) with all of its key's on the right, which are repeated for every `most` of the left: no key is one task's."""
    salted = left.withColumn("salt", F.floor(F.col("sub") / most))
    last = salted.groupBy(*keys).agg(F.max("salt").alias("last"))
    copies = right.join(last, keys).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    return salted.join(copies, [*keys, "salt"]).drop("salt")


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a symmetric matrix of links: each row that has a smaller one in its component, and the smallest there."""
    least = np.arange(len(near))
    while True:
        new = np.minimum(least, np.where(near, least[None, :], len(near)).min(axis=1))
        new = new[new]
        if (new == least).all():
            at = np.flatnonzero(least != np.arange(len(near)))
            return at, least[at]
        least = new


def ball(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit centre of unit rows, and the largest angle from it."""
    centre = m.sum(axis=0)
    length = np.sqrt(centre @ centre)
    centre = centre / length if length > 1e-6 else m[0]
    return centre, float(np.arccos(np.clip(m @ centre, -1.0, 1.0)).max())


def in_parts(rows: DataFrame, keys: list[str], most: int, by: str) -> DataFrame:
    """Column sub: the rows of a key in parts of about `most`, by hash of the column `by`."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    return rows.join(parts, keys).withColumn("sub", F.pmod(F.xxhash64(by, F.lit("block")), F.col("parts")).cast("int")).drop("parts")


def packed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each (keys, sub): the 64-bit columns as binary, and m, the unit vectors."""
    kinds = dict(rows.dtypes)

    def run(group: pa.Table) -> pa.Table:
        whole_column = lambda c: [np.ascontiguousarray(group.column(c).to_numpy()).tobytes()]
        out = {c: group.column(c).slice(0, 1) for c in [*keys, "sub"]} | {c: whole_column(c) for c in columns}
        return pa.table(out | {"m": [units(group.column("v").combine_chunks()).tobytes()]})

    fields = [*(f"{c} {kinds[c]}" for c in [*keys, "sub"]), *(f"{c} binary" for c in columns), "m binary"]
    return rows.select(*keys, "sub", *columns, "v").groupBy(*keys, "sub").applyInArrow(run, ", ".join(fields))


def dense_links(nodes: DataFrame, sized: DataFrame, *, dense: int, threshold: float, block_rows: int) -> DataFrame:
    """(a, b): each node that links with a component of more than `dense` nodes, and that component's name. Exact."""
    reach_of = np.arccos(threshold) + 1e-6
    vectors = nodes.select("n", "label", F.length("v").alias("bytes"), "v")
    members = sized.filter(F.col("size") > dense).select(F.col("node").alias("n"), "comp").join(vectors, "n")
    blocks = cut_lineage(packed(in_parts(members, ["label", "bytes", "comp"], block_rows, "n"), ["label", "bytes", "comp"], ["n"]))

    def centres(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.select(["n", "m"]).to_pylist():
            n = np.frombuffer(row["n"], "int64")
            centre, angle = ball(np.frombuffer(row["m"]).reshape(len(n), -1))
            yield pa.RecordBatch.from_arrays([pa.array([centre.tobytes()], pa.binary()), pa.array([angle])], names=["v", "angle"])

    def with_centre(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        balls = pa.Table.from_batches(list(centres(batch))).combine_chunks()
        keys = [batch.column(c) for c in ("label", "bytes", "comp")] + [batch.column("sub").cast(pa.int64())]
        yield pa.RecordBatch.from_arrays([*keys, balls.column("v").chunk(0), balls.column("angle").chunk(0)], names=["label", "bytes", "comp", "block", "v", "angle"])

    balls = whole(blocks, with_centre, "label string, bytes int, comp long, block long, v binary, angle double")
    balls = packed(in_parts(balls.withColumn("spot", F.xxhash64("comp", "block")), ["label", "bytes"], block_rows, "spot"), ["label", "bytes"], ["comp", "block", "angle"])
    named = vectors.join(sized.select(F.col("node").alias("n"), "comp"), "n", "left").withColumn("comp", F.coalesce("comp", "n"))
    every = packed(in_parts(named, ["label", "bytes"], block_rows, "n"), ["label", "bytes"], ["n", "comp"])

    def close(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            n, own, comp, block = (np.frombuffer(row[c], "int64") for c in ("n", "own", "comp", "block"))
            angle = np.arccos(np.clip(cosines(np.frombuffer(row["m"]).reshape(len(n), -1), np.frombuffer(row["centres"]).reshape(len(comp), -1)), -1.0, 1.0))
            i, j = np.nonzero((angle <= np.frombuffer(row["angle"]) + reach_of) & (own[:, None] != comp))
            yield pa.RecordBatch.from_arrays([pa.array(n[i]), pa.array(comp[j]), pa.array(block[j].astype("int32"))], names=["n", "comp", "block"])

    pairs = meet(every.select("label", "bytes", "sub", "n", F.col("comp").alias("own"), "m"), balls.select("label", "bytes", "comp", "block", "angle", F.col("m").alias("centres")), ["label", "bytes"])
    near = whole(pairs, close, "n long, comp long, block int")
    asked = packed(in_parts(near.join(vectors.select("n", "v"), "n"), ["comp", "block"], block_rows, "n"), ["comp", "block"], ["n"])

    def linked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            n, members = np.frombuffer(row["n"], "int64"), np.frombuffer(row["block_m"])
            m = np.frombuffer(row["m"]).reshape(len(n), -1)
            a = n[(cosines(m, members.reshape(-1, m.shape[1])) >= threshold).any(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.full(len(a), row["comp"], "int64"))], names=["a", "b"])

    own = blocks.select("comp", F.col("sub").alias("block"), F.col("m").alias("block_m"))
    return whole(asked.join(own, ["comp", "block"]), linked, "a long, b long").distinct()


def exact_links(nodes: DataFrame, *, threshold: float, block_rows: int) -> DataFrame:
    """(a, b): edges that connect what the links between the nodes connect, from all pairs of blocks of a label."""
    vectors = nodes.select("n", "label", F.length("v").alias("bytes"), "v")
    blocks = cut_lineage(packed(in_parts(vectors, ["label", "bytes"], block_rows, "n"), ["label", "bytes"], ["n"]))

    def linked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            n, o = np.frombuffer(row["n"], "int64"), np.frombuffer(row["o_n"], "int64")
            near = cosines(np.frombuffer(row["m"]).reshape(len(n), -1), np.frombuffer(row["o_m"]).reshape(len(o), -1)) >= threshold
            i, j = np.nonzero(near)
            if row["sub"] == row["o_sub"]:
                i, j = i[i != j], j[i != j]
            ids, at = np.unique(np.concatenate([n[i], o[j]]), return_inverse=True)
            if not len(ids):
                continue
            links = np.zeros((len(ids), len(ids)), bool)
            links[at[: len(i)], at[len(i) :]] = links[at[len(i) :], at[: len(i)]] = True
            a, b = spanning(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    others = blocks.select("label", "bytes", F.col("sub").alias("o_sub"), F.col("n").alias("o_n"), F.col("m").alias("o_m"))
    return whole(meet(blocks, others, ["label", "bytes"]).filter("sub <= o_sub"), linked, "a long, b long").distinct()


def near_duplicates(
    rows: DataFrame,
    *,
    threshold: float = 0.93,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    k: int = 8,
    tables: int = 4,
    bucket_rows: int = 64,
    group_rows: int = 192,
    min_rounds: int = 1,
    max_rounds: int = 6,
    audit: int = 256,
    min_recall: float = 0.98,
    block_rows: int = 256,
) -> DataFrame:
    """id, n_links (long), component_id (long), kept: one row for each row of the input."""
    spark = rows.sparkSession
    usable = valid(vector_column, rows.schema[vector_column].dataType) & F.exists(vector_column, lambda x: x != 0) & F.col(label_column).isNotNull() & F.col(id_column).isNotNull()
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), F.col(label_column).cast("string").alias("label"), usable.alias("usable"))

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, m in matrices(batch, "v"):
            m = m + 0.0  # no negative zeros
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("label").take(pick), pa.array([x.tobytes() for x in m], pa.binary())], names=["id", "label", "v"])

    points = whole(rows.filter("usable").select("id", "label", "v"), encode, "id long, label string, v binary")
    classes = points.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("weight"))
    # A node's id alone may repeat, if rows of other vectors share it: nodes are numbered by a hash of all that they are.
    nodes = cut_lineage(classes.withColumn("n", F.xxhash64("label", "v", "node")))
    size = nodes.count()
    if not size:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    bits = max(1, min(30, int(np.ceil(np.log2(max(2, size / bucket_rows))))))

    def signs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        blobs = batch.column("v").to_pylist()
        lengths = np.array([len(b) for b in blobs])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            pick = pa.array(at)
            m = units(batch.column("v").take(pick))
            for t in range(tables):
                plane = np.random.default_rng([t, m.shape[1]]).standard_normal((m.shape[1], bits))
                code = ((m @ plane) > 0) @ (1 << np.arange(bits, dtype="int64"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("n").take(pick), batch.column("label").take(pick), batch.column("v").take(pick), pa.array(np.full(len(at), t, "int32")), pa.array(code * 100_000 + m.shape[1])],
                    names=["n", "label", "v", "t", "code"],
                )

    coded = whole(nodes.select("n", "label", "v"), signs, "n long, label string, v binary, t int, code long")

    def compare(keep: int):
        def run(group: pa.Table) -> pa.Table:
            ids = group.column("n").to_numpy()
            return edge_batch(ids, cosines(units(group.column("v").combine_chunks())), keep, k, threshold)

        return run

    crowd = coded.groupBy("label", "t", "code").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts")).filter("parts > 1")
    spread = coded.join(crowd, ["label", "t", "code"], "left").withColumn("sub", F.pmod(F.xxhash64("n", "t"), F.coalesce("parts", F.lit(1))))
    graph = cut_lineage(best_lists(spread.groupBy("label", "t", "code", "sub").applyInArrow(compare(k), EDGE), k, k, threshold))

    def sampled(rest: DataFrame, most: int) -> tuple[DataFrame, bool]:
        """Links of at most `most` nodes of the rest, and whether these are all nodes of the rest."""
        sample = rest.orderBy(F.xxhash64("n", F.lit("audit")), "n").limit(most).select("n", "label", "v").collect()
        probes = spark.sparkContext.broadcast([(r["n"], r["label"], r["v"]) for r in sample])  # `most` vectors
        rows = whole(nodes.select("n", "label", "v"), lambda batch: probe(batch, probes), "a long, b long").filter("a <> b")
        return cut_lineage(rows), len(sample) < most

    def probe(batch: pa.RecordBatch, probes) -> Iterator[pa.RecordBatch]:
        labels, blobs, ids = batch.column("label").to_pylist(), batch.column("v").to_pylist(), batch.column("n").to_numpy()
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(labels, map(len, blobs), strict=True)):
            groups.setdefault(key, []).append(i)
        for (label, length), at in groups.items():
            own = [(n, v) for n, x, v in probes.value if x == label and len(v) == length]
            if own:
                s = cosines(units(batch.column("v").take(pa.array(at))), units(pa.array([v for _, v in own], pa.binary())))
                i, j = np.nonzero(s >= threshold)
                a, b = np.array([n for n, _ in own])[j], ids[np.array(at)[i]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def judge(truth: DataFrame) -> tuple[int, int]:
        """Sampled nodes with links outside dense components, and those of them whose links all lie in their component."""
        named = lambda c: sized.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"), F.col("size").alias(f"{c}_size"))
        checked = truth.join(named("a"), "a", "left").join(named("b"), "b", "left").filter(F.coalesce("a_size", F.lit(1)) <= k).filter(F.coalesce("b_size", F.lit(1)) <= k)
        right = checked.groupBy("a").agg(F.min(F.coalesce(F.col("a_comp") == F.col("b_comp"), F.lit(False)).cast("int")).alias("right"))
        got = right.agg(F.count("*").alias("all"), F.sum("right").alias("found")).first()
        return got["all"], got["found"] or 0

    links, sound = graph.filter(F.col("s") >= threshold).select("a", "b"), False
    for turn in range(max_rounds + 1):
        reach = components(links)
        sized = cut_lineage(reach.join(reach.groupBy("comp").agg(F.count("*").alias("size")), "comp").select("node", "comp", "size"))
        dense = sized.filter(F.col("size") > k)
        rest = nodes.join(dense.select(F.col("node").alias("n")), "n", "left_anti")
        if turn == min(min_rounds, max_rounds):
            most, every, judged = audit, False, 0
            while not every and judged < audit // 4 and most <= 16 * audit:
                truth, every = sampled(rest, most)
                judged, most = judge(truth)[0], 4 * most
        if turn >= min(min_rounds, max_rounds):
            judged, found = judge(truth)
            enough = every or judged >= audit // 4
            sound = enough and found >= min_recall * judged
            if sound or not enough or turn == max_rounds:
                break
        for c in ("a", "b"):
            graph = graph.join(dense.select(F.col("node").alias(c)), c, "left_anti")
        both = graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        both = both.unionByName(graph.select("a", F.col("a").alias("b")).distinct())  # a node meets its list, too
        crowd = both.groupBy("a").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts")).filter("parts > 1")
        spread = both.join(crowd, "a", "left").withColumn("sub", F.pmod(F.xxhash64("b", F.lit(turn)), F.coalesce("parts", F.lit(1))))
        met = spread.withColumnRenamed("b", "n").join(nodes.select("n", "v"), "n").select("a", "sub", "n", "v")
        found = met.groupBy("a", "sub").applyInArrow(compare(3), EDGE)
        graph = cut_lineage(best_lists(graph.unionByName(found), k, k * (turn + 2), threshold))
        links = sized.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(graph.filter(F.col("s") >= threshold).select("a", "b"))

    links = sized.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(dense_links(nodes, sized, dense=k, threshold=threshold, block_rows=block_rows))
    if not sound:
        links = links.unionByName(exact_links(rest, threshold=threshold, block_rows=block_rows))
    reach = components(links)

    # Components as lists: blocks of vectors, multiplied pair by pair, give each vector's links without writing pairs.
    members = reach.select(F.col("node").alias("n"), "comp").join(nodes, "n")
    crowd = reach.groupBy("comp").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    blocked = members.join(crowd, "comp").withColumn("sub", F.pmod(F.xxhash64("n", F.lit("block")), F.col("parts")).cast("int"))

    def to_block(group: pa.Table) -> pa.Table:
        column = lambda c: [group.column(c).to_numpy().astype("int64").tobytes()]
        m = units(group.column("v").combine_chunks())
        return pa.table({"comp": group.column("comp").slice(0, 1), "sub": group.column("sub").slice(0, 1), "ns": column("n"), "weights": column("weight"), "m": [m.tobytes()]})

    blocks = cut_lineage(blocked.groupBy("comp", "sub").applyInArrow(to_block, "comp long, sub int, ns binary, weights binary, m binary"))

    def count_links(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            ns, weights = np.frombuffer(row["ns"], "int64"), np.frombuffer(row["o_weights"], "int64")
            a, b = np.frombuffer(row["m"]).reshape(len(ns), -1), np.frombuffer(row["o_m"]).reshape(len(weights), -1)
            near = cosines(a, b) >= threshold
            if row["sub"] == row["o_sub"]:
                np.fill_diagonal(near, False)
            yield pa.RecordBatch.from_arrays([pa.array(ns), pa.array(near @ weights)], names=["n", "links"])

    others = blocks.select("comp", F.col("sub").alias("o_sub"), F.col("weights").alias("o_weights"), F.col("m").alias("o_m"))
    pairs = meet(blocks, others, ["comp"])
    linked = whole(pairs, count_links, "n long, links long").groupBy("n").agg(F.sum("links").alias("links"))

    named = reach.select(F.col("node").alias("n"), "comp").join(nodes.select("n", "node"), "n")
    least = named.groupBy("comp").agg(F.min("node").alias("component"))
    info = nodes.join(named.select("n", "comp"), "n", "left").join(least, "comp", "left").join(linked, "n", "left")
    info = info.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    known = points.join(info, ["label", "v"]).select("id", "n_links", "component_id")
    rest = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = known.unionByName(rest)
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
