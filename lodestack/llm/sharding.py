"""Operator 7, sharding by Hilbert-curve order.

Several metadata columns are quantised to the same number of bits each, and the index of the cell on the Hilbert curve of
that many dimensions orders the rows: rows close in all columns lie close on the curve, so that files and shards, cut as
runs of that order, have narrow ranges in each column and are pruned by any of them.

Whole rows are dealt to files by runs of the curve of about equal bytes, a hot cell parted by hash, sorted, and written once. A
row's position follows from its file and its place in it, and from one count a file. Shard s holds the positions
from ceil(s * n / shards) on: counts are at most one apart (law `rows`).

Cases: a null in a quantised column is a value of its own (the lowest); numbers, negative ones too, are quantised by the
quantiles of their rows, other values by boundaries between equally many distinct values, in their order, however many there
are; a null text has size 1 and crc32 0; ties on the curve and the id are ordered by text, repeated rows get positions of their own; earlier columns
named as the outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import cut_lineage, partitions

OUTPUTS = ("shard", "slot", "curve", "file", "place")


def hilbert(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of the axes' values (0 .. 2**bits - 1), after Skilling's transpose form, as one expression of integer columns.

    The state is an array of the axes; each step is a `transform`-free rebuild of that array, kept small by `let`.
    """
    n = len(axes)

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def untwist(x: Column, q: int, i: int) -> Column:
        """Invert the low bits of axis 0 if axis i has bit q, else exchange them with those of axis i."""
        p = F.lit(q - 1)
        xi, x0 = x[i], x[0]
        swap = x0.bitwiseXOR(xi).bitwiseAND(p)
        first = F.when(xi.bitwiseAND(F.lit(q)) != 0, x0.bitwiseXOR(p)).otherwise(x0.bitwiseXOR(swap))
        other = F.when(xi.bitwiseAND(F.lit(q)) != 0, xi).otherwise(xi.bitwiseXOR(swap))
        if i == 0:
            return F.array(F.when(x0.bitwiseAND(F.lit(q)) != 0, x0.bitwiseXOR(p)).otherwise(x0), *[x[k] for k in range(1, n)])
        return F.array(first, *[other if k == i else x[k] for k in range(1, n)])

    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]

    def gray(x: Column) -> Column:
        values = [x[0]]
        for k in range(1, n):
            values.append(x[k].bitwiseXOR(values[-1]))
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            q = 1 << b
            t = F.when(values[-1].bitwiseAND(F.lit(q)) != 0, t.bitwiseXOR(F.lit(q - 1))).otherwise(t)
        return let(F.struct(F.array(*values).alias("v"), t.alias("t")), lambda s: F.transform(s["v"], lambda v: v.bitwiseXOR(s["t"])))

    def interleave(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for k in range(n):
                bit = F.shiftright(x[k], b).bitwiseAND(F.lit(1)).cast("long")
                out = out.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - k))
        return out

    def run(x: Column, left: list[tuple[int, int]]) -> Column:
        if not left:
            return let(gray(x), interleave)
        return let(untwist(x, *left[0]), lambda y: run(y, left[1:]))

    return let(F.array(*[a.cast("int") for a in axes]), lambda x: run(x, steps))


def boundaries(df: DataFrame, columns: tuple[str, ...], bits: int) -> dict[str, list]:
    """For each column at most 2**bits - 2 values that part its rows (numbers) or its distinct values (others) about evenly."""
    cells = (1 << bits) - 1
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    out: dict[str, list] = {}
    if numeric:
        shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
        found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, F.lit(1000)).alias(f"q{i}") for i, c in enumerate(numeric)]).first()
        out = {c: sorted(set(found[i] or [])) for i, c in enumerate(numeric)}
    for c in columns:
        if c not in out:
            values = df.select(F.col(c).cast("string").alias("x")).filter("x is not null").distinct()
            parts = values.repartitionByRange(cells, "x").groupBy(F.spark_partition_id().alias("part")).agg(F.min("x").alias("x"))
            starts = sorted(r["x"] for r in parts.collect())  # a row for each part, however many values there are
            out[c] = starts[1 :: -(-len(starts) // cells)] if starts else []
    return out


def quantise(df: DataFrame, column: str, bounds: list) -> Column:
    """0 for null, else 1 and one more for each boundary that the value reaches."""
    col = F.col(column).cast("double" if isinstance(df.schema[column].dataType, T.NumericType) else "string")
    rank = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= col)) + 1 if bounds else F.lit(1)
    return F.when(col.isNull(), F.lit(0)).otherwise(rank).cast("int")


def write_shards(
    df: DataFrame,
    path: str,
    *,
    dimensions: tuple[str, ...] = ("lang", "source", "n_chars"),
    bits: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
    files: int | None = None,
    file_bytes: int = 128 << 20,
) -> None:
    """Write all rows and columns once, in curve order, as Parquet files that hold runs of it; `file` and `place` are added.

    Runs are cut by the bytes of text before them, so files are about equally long whatever the curve sorts by: as many as
    there are shuffle partitions, and more where they would be over `file_bytes`. One scan adds up the bytes of the curve's
    cells, at most 2 ** (bits * number of dimensions) rows; a cell over a quarter of a file is cut by hash of id and text.
    """
    if bits * len(dimensions) > 18:
        raise ValueError(f"{bits} bits for each of {len(dimensions)} dimensions make more than 2**18 cells; lower bits")
    spark = df.sparkSession
    df = df.drop(*(set(OUTPUTS) - {id_column, text_column}))
    bounds = boundaries(df, dimensions, bits)
    curved = df.withColumn("curve", hilbert([quantise(df, d, bounds[d]) for d in dimensions], bits))
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + 1
    cells = cut_lineage(curved.groupBy("curve").agg(F.sum(size).alias("bytes")))
    total = cells.agg(F.sum("bytes")).first()[0] or 0
    n_files = files or max(partitions(spark), -(-total // file_bytes))
    target = max(1.0, total / n_files)
    before = F.sum("bytes").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select("curve", F.coalesce(before, F.lit(0)).alias("cell_start"), "bytes", F.ceil(F.col("bytes") * 4 / target).alias("cell_parts"))
    starts = starts.select(F.col("curve").alias("cell"), "cell_start", "cell_parts", (F.col("bytes") / F.col("cell_parts")).alias("cell_step"))
    dealt = curved.join(F.broadcast(starts), F.col("curve") == F.col("cell"))  # 2**18 rows at most
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(id_column, text_column), F.col("cell_parts")))
    file = F.least(F.floor((F.col("cell_start") + F.col("part") * F.col("cell_step")) / target), F.lit(n_files - 1)).cast("int")
    dealt = dealt.withColumn("file", file).drop("cell", "cell_start", "cell_parts", "cell_step")
    ordered = dealt.repartitionById(n_files, F.col("file")).sortWithinPartitions("curve", "part", id_column, text_column).drop("part")
    ordered.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)


def read_shards(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """The rows with shard (0 to shards - 1) and slot (gapless in its shard), by law `rows`."""
    rows = spark.read.parquet(path)
    # One row a file, from a column of its own: the window's single task reads as many rows as there are files.
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    everything = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("file", F.coalesce(base, F.lit(0)).alias("shard_base"), F.sum("n").over(everything).alias("shard_all"))
    position = F.col("shard_base") + F.col("place")
    out = rows.join(F.broadcast(bases), "file").withColumn("shard_position", position)
    # The largest s with ceil(s * n / shards) <= position.
    out = out.withColumn("shard", F.expr(f"cast((shard_position * {shards}) div shard_all as int)"))
    start = F.expr(f"(shard * shard_all + {shards} - 1) div {shards}")
    return out.withColumn("slot", F.col("shard_position") - start).drop("shard_base", "shard_all", "shard_position")
