"""Operator 2, exact top-k search by inner product with an M-tree and best-first search.

The tree has four levels, each stored with covering radii and the distance of a node's pivot to its parent's: the root parts the
vectors among at most `root_cells` pivots (a documented sample; every vector is indexed); a cell's directory holds the pivots of
its pages in blocks of bounded size; a page holds at most about `page_rows` vectors, and no more than `page_bytes`; its leaves
hold vectors in descending distance from the leaf's pivot. A cell is parted into pages by the sides of hyperplanes through
its pivot, and what one side still has too much of by row, so no task holds a hot cell. Only the root is on the driver.

For a query q and a vector x below a node of pivot c and radius r, q.x <= q.c + |q| r; and, from the parent's pivot p alone,
q.x <= q.p + |q| (d(p, c) + r), which saves computing q.c, or q.x in a leaf.

Queries run in blocks: first against the nearest pages, which give each a lowest score to beat; then down the tree, into all nodes
whose bound reaches that score. A page's leaves are opened best first, each for the queries of the block that it can still
serve. A block and a page are one row of a join, salted by block; results are merged by rank.

Scores are exact: doubles hold them where number of components * largest component of either side < 2**53; elsewhere bounds
are widened by the rounding error, and what may be among the best is computed again in whole numbers, held to the range of a long.

Cases: vectors that are null, empty, or hold null or non-finite components (scaled, too) take no part, nor do rows without an id;
vectors are compared with those of equally many components; ties go to the smaller id; rows that repeat a candidate's id are
candidates of their own, but none of the query's own id; of rows that repeat a query's id, one of the fewest components, then the
least in bytes, is the query; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import cut_lineage, partitions
from lodestack.llm.vectors import matrices, valid, whole

EXACT, LONG = float(1 << 53), (1 << 63) - 1
PAGE = "page string, dim int, cell int, pivot binary, radius double, apart double, ids binary, vectors binary, away binary, leaf_at binary, leaf_pivots binary, leaf_radius binary, leaf_apart binary"
BLOCK = "ids binary, vectors binary, floors binary"


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def packed(m: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three kinds that holds them; `unpacked` tells the kind by the length."""
    most = np.abs(m).max(initial=0)
    return m.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8").tobytes()


def unpacked(blob: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, {2: "<i2", 4: "<i4", 8: "<f8"}[len(blob) // (rows * dim)]).reshape(rows, dim).astype("float64")


def stack(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.concatenate([unpacked(b, 1, dim) for b in blobs])


def reach(at: np.ndarray, lengths: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x nodes) of inner products, from those with the pivots, with room for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = at + lengths[:, None] * radius
        bound += 1e-9 * (1 + lengths[:, None]) * (1 + radius) + 1e-12 * np.abs(at)
    return np.where(np.isnan(bound), np.inf, bound)


class Page:
    """One stored page: vectors in leaves, with the bounds that keep leaves and vectors closed."""

    @staticmethod
    def stored(ids: np.ndarray, m: np.ndarray, leaf: int) -> dict[str, bytes | float]:
        with np.errstate(over="ignore", invalid="ignore"):
            pivot = m.mean(axis=0)
            # Leaves by the nearest of vectors spread over the page; equal vectors share one.
            picks = np.unique(m[np.linspace(0, len(m) - 1, max(1, len(m) // leaf)).astype("int64")], axis=0)
            near = (m @ picks.T - 0.5 * np.einsum("ij,ij->i", picks, picks)).argmax(axis=1)
            order, at, pivots, radius, away = [], [0], [], [], []
            for k in np.unique(near):
                rows = np.flatnonzero(near == k)
                centre = m[rows].mean(axis=0)
                far = norms(m[rows] - centre)
                turn = np.argsort(-far, kind="stable")
                order.append(rows[turn])
                away.append(far[turn])
                pivots.append(centre)
                radius.append(np.nan_to_num(far.max(), nan=np.inf))
                at.append(at[-1] + len(rows))
            order, pivots = np.concatenate(order), np.stack(pivots)
            apart = norms(pivots - pivot)
            farthest = float(np.nan_to_num(norms(m - pivot).max(), nan=np.inf))
        blob = lambda x, kind="<f8": np.asarray(x, kind).tobytes()
        return {
            "pivot": blob(pivot), "radius": farthest, "ids": blob(ids[order], "<i8"), "vectors": packed(m[order]), "away": blob(np.nan_to_num(np.concatenate(away), nan=np.inf)),
            "leaf_at": blob(at, "<i8"), "leaf_pivots": blob(pivots), "leaf_radius": blob(radius), "leaf_apart": blob(np.nan_to_num(apart, nan=np.inf)),
        }

    def __init__(self, row: dict):
        real = lambda c: np.frombuffer(row[c], "<f8")
        self.name, self.ids, self.pivot = row["page"], np.frombuffer(row["ids"], "<i8"), real("pivot")
        dim = len(self.pivot)
        self.vectors, self.away, self.at = unpacked(row["vectors"], len(self.ids), dim), real("away"), np.frombuffer(row["leaf_at"], "<i8")
        self.pivots, self.radius, self.apart = real("leaf_pivots").reshape(-1, dim), real("leaf_radius"), real("leaf_apart")
        self.most = float(np.abs(self.vectors).max(initial=0))

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of each query's k best vectors that reach its floor."""
        n, dim = queries.shape
        exact = dim * self.most * float(np.abs(queries).max(initial=0)) < EXACT
        with np.errstate(over="ignore", invalid="ignore"):
            lengths = np.nan_to_num(norms(queries), nan=np.inf)
            # What a rounded score may be off by, of a score held to the range of a long.
            error = np.zeros(n) if exact else np.nan_to_num(2.0**-50 * dim * lengths * np.sqrt(dim) * self.most, nan=np.inf)
            low = floors - (0 if exact else np.abs(np.nan_to_num(floors, neginf=0.0)) * 2.0**-50)
            low = np.where(low <= -float(LONG), -np.inf, np.minimum(low, float(LONG)))
            by_parent = reach((queries @ self.pivot)[:, None], lengths, self.apart + self.radius)
            opened = np.flatnonzero((by_parent >= low[:, None]).any(axis=0))
            at_leaf = queries @ self.pivots[opened].T
        bound = np.minimum(by_parent[:, opened], reach(at_leaf, lengths, self.radius[opened]))
        best = np.full((n, k), -np.inf)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable"):
            who = np.flatnonzero(bound[:, j] >= low)
            if not len(who):
                continue
            a, b = self.at[opened[j]], self.at[opened[j] + 1]
            # Vectors are in descending distance from the pivot: those too close to it for every query of the block stay closed.
            serves = reach(at_leaf[who, j][:, None], lengths[who], self.away[a:b]) >= low[who][:, None]
            rows = a + np.flatnonzero(serves.any(axis=0))
            with np.errstate(over="ignore", invalid="ignore"):
                scores = queries[who] @ self.vectors[rows].T
            scores = np.where(np.isnan(scores), np.inf, scores)
            other = own[who][:, None] != self.ids[rows]
            upper, lower = scores + error[who][:, None], np.where(other, np.nan_to_num(scores - error[who][:, None], nan=-np.inf), -np.inf)
            q, x = np.nonzero(other & (upper >= low[who][:, None]))
            hits.append((who[q], rows[x], scores[q, x]))
            best[who] = np.partition(np.concatenate([best[who], lower], axis=1), -k, axis=1)[:, -k:]
            kth = np.minimum(best[who].min(axis=1), float(LONG))
            low[who] = np.maximum(low[who], np.where(kth <= -float(LONG), -np.inf, kth))
        if not hits:
            return (np.zeros(0, "int64"),) * 3
        q, x, s = (np.concatenate(c) for c in zip(*hits, strict=True))
        stay = s + error[q] >= low[q]
        q, x, s = q[stay], x[stay], s[stay]
        if exact:
            s = s.astype("int64")
        else:
            s = np.array([max(-LONG - 1, min(LONG, sum(int(u) * int(v) for u, v in zip(queries[i], self.vectors[r], strict=True)))) for i, r in zip(q, x, strict=True)], "int64")
        ids = self.ids[x]
        order = np.lexsort((ids, ~s, q))  # ~s descends with s, and no whole number overflows
        q, ids, s = q[order], ids[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], ids[rank < k], s[rank < k]


def in_parts(rows: DataFrame, keys: list[str], most: Column, name: str) -> DataFrame:
    """Column `name`: the rows of a key in parts of about `most`, by hash of the column `row`."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.first(most)).cast("int").alias("parts"))
    return rows.join(parts, keys).withColumn(name, F.pmod(F.xxhash64("row", F.lit(name)), F.col("parts")).cast("int")).drop("parts")


def blocks_of(wait: dict, key, size: int, dim: int) -> dict[str, list]:
    """Takes the queries that wait for a node, as one block."""
    got = wait.pop(key)
    return {"ids": [np.array([g[0] for g in got], "<i8").tobytes()], "vectors": [packed(np.stack([g[1] for g in got]))], "floors": [np.array([g[2] for g in got], "<f8").tobytes()]}


def top_k(
    rows: DataFrame,
    *,
    is_query: Column,
    k: int = 10,
    scale: float = 1024.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    page_rows: int = 4096,
    page_bytes: int = 4 << 20,
    root_cells: int = 256,
    directory_pages: int = 512,
    query_block: int = 128,
    salt_blocks: int = 8,
    leaf: int = 64,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query row, by the inner product of floor(scale * x)."""
    spark = rows.sparkSession
    n_out = partitions(spark)
    rows = rows.withColumn("mtree_query", F.coalesce(is_query, F.lit(False)))
    rows = rows.filter(valid(vector_column, rows.schema[vector_column].dataType) & F.col(id_column).isNotNull())
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col("mtree_query").alias("q"), F.col(vector_column).alias("v"))

    def quantise(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, q = batch.column("id"), batch.column("q")
        for at, m in matrices(batch, "v"):
            with np.errstate(over="ignore"):
                m = np.floor(scale * m)
            finite = np.isfinite(m).all(axis=1)
            at, m = at[finite], m[finite]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), q.take(pa.array(at)), pa.array(np.full(len(at), m.shape[1], "int32")), pa.array([packed(x) for x in m], pa.binary())], names=["id", "q", "dim", "v"]
            )

    points = whole(rows, quantise, "id long, q boolean, dim int, v binary")
    points = cut_lineage(points.withColumn("row", F.monotonically_increasing_id()))
    counts = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each number of dimensions
    total = sum(counts.values())
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = {dim: max(leaf, min(page_rows, page_bytes // (8 * dim))) for dim in counts}
    wanted = max(1, min(root_cells, sum(-(-n // size[dim]) for dim, n in counts.items())))
    sample = points.orderBy(F.xxhash64("id", F.lit("pivot")), "row").limit(wanted).select("dim", "v").collect()
    pivots: dict[int, np.ndarray] = {dim: np.zeros((1, dim)) for dim in counts}  # for a number of dimensions that the sample misses
    for dim in {r["dim"] for r in sample}:
        pivots[dim] = np.unique(stack([r["v"] for r in sample if r["dim"] == dim], dim), axis=0)
    known = spark.sparkContext.broadcast(pivots)

    def nearest(m: np.ndarray) -> np.ndarray:
        p = known.value[m.shape[1]]
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num(m @ p.T - 0.5 * np.einsum("ij,ij->i", p, p), nan=-np.inf).argmax(axis=1)

    def placing(bits: dict[tuple[int, int], int]):
        def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            dims, blobs = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            cell, side = np.zeros(batch.num_rows, "int32"), np.zeros(batch.num_rows, "int64")
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                m = stack([blobs[i] for i in at], dim)
                cell[at] = nearest(m)
                most = max((n for (d, _), n in bits.items() if d == dim), default=0)
                if most:
                    planes = np.random.default_rng([7, dim]).standard_normal((dim, most))
                    sides = ((m - known.value[dim][cell[at]]) @ planes) > 0
                    own = np.array([bits.get((dim, c), 0) for c in cell[at].tolist()])
                    side[at] = (sides & (np.arange(most) < own[:, None])) @ (1 << np.arange(most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(side)], names=[*batch.schema.names, "cell", "side"])

        return place

    kind = "id long, dim int, v binary, row long, cell int, side long"
    plain = points.select("id", "dim", "v", "row")
    cells = {(r["dim"], r["cell"]): r["n"] for r in whole(plain, placing({}), kind).groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}  # root_cells rows and one for each dimension
    bits = {(dim, cell): min(30, int(np.ceil(np.log2(n / size[dim])))) for (dim, cell), n in cells.items() if n > size[dim]}
    most = F.lit(page_rows)
    for dim, n in size.items():
        most = F.when(F.col("dim") == dim, F.lit(n)).otherwise(most)
    paged = in_parts(whole(plain, placing(bits), kind), ["dim", "cell", "side"], most, "sub")

    def load_page(group: pa.Table) -> pa.Table:
        dim, cell, side, sub = (group.column(c)[0].as_py() for c in ("dim", "cell", "side", "sub"))
        page = Page.stored(group.column("id").to_numpy().astype("int64"), stack(group.column("v").to_pylist(), dim), leaf)
        parent = known.value[dim][cell]
        with np.errstate(over="ignore", invalid="ignore"):
            apart = float(np.nan_to_num(norms((np.frombuffer(page["pivot"], "<f8") - parent)[None])[0], nan=np.inf))
        row = {"page": f"{dim}/{cell}/{side}/{sub}", "dim": pa.scalar(dim, pa.int32()), "cell": pa.scalar(cell, pa.int32())} | page | {"apart": apart}
        return pa.table({c: [row[c].as_py() if isinstance(row[c], pa.Scalar) else row[c]] for c in names}, schema=schema)

    names = [f.split()[0] for f in PAGE.split(", ")]
    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], arrow[f.split()[1]]) for f in PAGE.split(", ")])
    pages = cut_lineage(paged.groupBy("dim", "cell", "side", "sub").applyInArrow(load_page, PAGE))

    # The directory: descriptions of a cell's pages, in blocks.
    described = pages.select("dim", "cell", "page", "pivot", "radius", "apart", F.col("page").alias("row"))
    described = in_parts(described, ["dim", "cell"], F.lit(directory_pages), "part")
    held = [F.collect_list(F.struct("page", "pivot", "radius", "apart")).alias("nodes")]
    directory = cut_lineage(described.groupBy("dim", "cell", "part").agg(*held))
    root_rows = pages.groupBy("dim", "cell").agg(F.max(F.col("apart") + F.col("radius")).alias("radius")).collect()  # a row for each cell
    root = {dim: sorted((r["cell"], r["radius"]) for r in root_rows if r["dim"] == dim) for dim in counts}
    top = spark.sparkContext.broadcast(root)

    def descend(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wait: dict[tuple[int, int], list[tuple]] = {}

            def out(key: tuple[int, int]) -> pa.RecordBatch:
                block = {"dim": pa.array([key[0]], pa.int32()), "cell": pa.array([key[1]], pa.int32())} | blocks_of(wait, key, query_block, key[0])
                return pa.RecordBatch.from_pydict(block)

            for batch in batches:
                ids, dims, blobs, floors = (batch.column(c).to_pylist() for c in ("id", "dim", "v", "floor"))
                for qid, dim, blob, floor in zip(ids, dims, blobs, floors, strict=True):
                    q = unpacked(blob, 1, dim)
                    cell, radius = (np.array(x) for x in zip(*top.value[dim], strict=True))
                    with np.errstate(over="ignore", invalid="ignore"):
                        at = q @ known.value[dim][cell].T
                        bound = reach(at, np.nan_to_num(norms(q), nan=np.inf), radius)[0]
                    chosen = [int(np.nan_to_num(at[0], nan=-np.inf).argmax())] if first else np.flatnonzero(bound >= floor)
                    for j in chosen:
                        key = (dim, int(cell[j]))
                        wait.setdefault(key, []).append((qid, q[0], floor))
                        if len(wait[key]) >= query_block:
                            yield out(key)
            for key in list(wait):
                yield out(key)

        return run

    def to_pages(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    dim, ids, floors = row["dim"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["floors"], "<f8")
                    queries, nodes = unpacked(row["vectors"], len(ids), dim), row["nodes"]
                    radius, apart = (np.array([x[c] for x in nodes]) for c in ("radius", "apart"))
                    with np.errstate(over="ignore", invalid="ignore"):
                        lengths = np.nan_to_num(norms(queries), nan=np.inf)
                        may = reach((queries @ known.value[dim][row["cell"]])[:, None], lengths, apart + radius) >= floors[:, None]
                        open_nodes = np.flatnonzero(may.any(axis=0))
                        at = queries @ np.stack([np.frombuffer(nodes[j]["pivot"], "<f8") for j in open_nodes]).T if len(open_nodes) else np.zeros((len(ids), 0))
                    if first:
                        chosen = np.zeros(at.shape, bool)
                        chosen[np.arange(len(ids)), np.nan_to_num(at, nan=-np.inf).argmax(axis=1)] = True
                    else:
                        chosen = may[:, open_nodes] & (reach(at, lengths, radius[open_nodes]) >= floors[:, None])
                    for j, node in enumerate(open_nodes):
                        who = np.flatnonzero(chosen[:, j])
                        if len(who):
                            data = [[nodes[node]["page"]], [ids[who].tobytes()], [packed(queries[who])], [floors[who].tobytes()]]
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=["page", "ids", "vectors", "floors"])

        return run

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: Page | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if loaded is None or loaded.name != row["page"]:
                    loaded = Page(row)
                own, floors = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_floors"], "<f8")
                q, ids, scores = loaded.search(unpacked(row["q_vectors"], len(own), row["dim"]), own, floors, k)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype("int64")) for x in (own[q], ids, scores)], names=["query_id", "vec_id", "score"])

    def answers(asked: DataFrame, first: bool) -> DataFrame:
        routed = asked.mapInArrow(descend(first), f"dim int, cell int, {BLOCK}")
        blocks = cut_lineage(routed.join(directory, ["dim", "cell"]).mapInArrow(to_pages(first), f"page string, {BLOCK}"))
        # A page that many blocks visit is repeated for every `salt_blocks` of them.
        parts = blocks.groupBy("page").agg(F.ceil(F.count("*") / salt_blocks).cast("int").alias("parts"))
        salted = blocks.join(parts, "page").withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int"))
        salted = salted.select("page", "salt", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "floors")])
        copies = pages.drop("cell", "radius", "apart").join(parts, "page").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return salted.join(copies, ["page", "salt"]).mapInArrow(visit, "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    queries = points.filter("q").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("s")).select("id", "s.dim", "s.v")
    queries = cut_lineage(queries.repartition(n_out, "id"))
    unknown = F.lit(float("-inf")).alias("floor")
    # The k-th score of the nearest pages is a score to reach; a query with fewer answers has none yet.
    one = best(answers(queries.select("id", "dim", "v", unknown), True)).filter(F.col("rank") == k)
    floors = one.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    second = queries.join(floors, "id", "left").select("id", "dim", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    return best(answers(second, False)).select("query_id", "rank", "vec_id", "score")
