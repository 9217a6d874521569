"""Operator 11, resampling of irregular series: covered time, integral and average of a signal in each bucket of time.

Time is cut into leaves, each inside one bucket. A leaf's summary is its first point, its last point and its totals: points,
covered seconds and twice the integral between its points. Summaries are associative: a round of the tree merges up to
`fan_in` neighbouring nodes of a key into their parent, whose first and last points are those of its ends, and integrates
only the segments that join one node's last point to the next one's first. Those segments' parts by bucket stand in the
parent's row; totals below are left where they were made, so no row grows with the length of a series. Rounds go on until one node spans
all time; its last point's tail is added, and one aggregation by key and bucket adds up what all rounds made.

Every round deals (key, parent) out by hash, so a hot key is spread over its nodes, and a group never holds more than the seconds of
a leaf or `fan_in` summaries. Each level is written once in the shared folder. Only the first and last leaf's numbers reach the driver.

Whole numbers throughout: times in seconds, values as longs, quotients floored. The parts of a product are divided before they
are multiplied, so a quotient is exact wherever the result itself fits a long.

Cases: rows with a null key, time or value are dropped, as are values that are no finite number or beyond a long; of the rows of a key in
one second the one of the largest order counts (null: smallest; ties: the largest value), so repeated rows change nothing; a
single point is a series; an empty table gives no rows; texts play no part; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import scratch


def floor_div(a: Column, b: Column) -> Column:
    """The quotient of longs, floored; b is over 0."""
    return F.call_function("div", a - F.pmod(a, b), b)


def epoch_seconds(rows: DataFrame, column: str) -> Column:
    """Whole seconds since 1970 of a timestamp, floored; one without a zone is taken as UTC, whatever the session's zone is."""
    ts = F.col(column)
    if isinstance(rows.schema[column].dataType, T.TimestampNTZType):
        days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.unix_seconds(ts)


def latest_points(rows: DataFrame, *, key_column: str, time_column: str, value_column: str, order_column: str, scale: int = 100) -> DataFrame:
    """key, t, v: one point a second of each key, v = floor(scale * value + 0.5)."""
    scaled = F.lit(scale) * F.col(value_column) + F.lit(0.5)
    each = rows.select(F.col(key_column).alias("key"), epoch_seconds(rows, time_column).alias("t"), F.when(F.abs(scaled) < 2.0**62, F.floor(scaled)).alias("v"), F.col(order_column).alias("o"))
    each = each.filter("key is not null and t is not null and v is not null")
    # The largest order first; a null one is below all others.
    return each.groupBy("key", "t").agg(F.coalesce(F.max_by("v", F.when(F.col("o").isNotNull(), F.struct("o", "v"))), F.max("v")).alias("v"))


def integral2(u: Column, v: Column, w: Column | None, d: Column | None) -> Column:
    """Twice the integral of a segment's first u seconds: 2vu + floor((w - v)uu / d); w None: the signal is a step."""
    flat = 2 * v * u
    if w is None:
        return flat
    rise, whole, rest = w - v, F.call_function("div", u * u, d), (u * u) % d
    over = F.pmod(rise, d)
    return flat + floor_div(rise, d) * u * u + over * whole + F.call_function("div", over * rest, d)


def covered(gap: Column, step: bool, max_gap: int) -> Column:
    """How many seconds of a segment are covered, `gap` seconds being between its points; none where no point follows."""
    limit = F.lit(max_gap).cast("long")
    return F.when(gap <= limit, gap).otherwise(F.when(gap.isNotNull(), limit if step else F.lit(0).cast("long")))


def parts(t: Column, v: Column, w: Column | None, d: Column | None, cover: Column, bucket: int) -> Column:
    """A segment's parts by bucket: array of (bucket, covered, area2); a bucket takes the difference between its ends."""
    size = F.lit(bucket).cast("long")
    first = floor_div(t, size)
    last = floor_div(t + cover - 1, size)

    def part(b: Column) -> Column:
        low, high = F.greatest(b * size, t) - t, F.least(b * size + size, t + cover) - t
        return F.struct((b * size).alias("bucket"), (high - low).alias("covered"), (integral2(high, v, w, d) - integral2(low, v, w, d)).alias("area2"))

    return F.when(cover > 0, F.transform(F.sequence(first, F.greatest(last, first)), part))


def leaf_of(bucket: int, most: int = 21600) -> int:
    """The longest leaf of at most `most` seconds that divides the bucket."""
    return next(bucket // n for n in range(-(-bucket // most), bucket + 1) if bucket % n == 0)


def resample(points: DataFrame, *, bucket: int = 21600, max_gap: int = 300, signal: str = "step", fan_in: int = 32) -> DataFrame:
    """key, bucket_start, n_points, covered_seconds, area2, avg of the buckets that hold points or covered time.

    Points are key, t, v, one a second of a key, as `latest_points` gives them. As a step, v lasts until the next point, at most `max_gap`
    seconds, and a key's last point lasts all of these; linear, v runs straight to the next point if it's at most so far away.
    """
    if signal not in ("step", "linear"):
        raise ValueError("signal is step or linear")
    if bucket < 1 or max_gap < 1 or fan_in < 2:
        raise ValueError("bucket and max_gap are 1 at least, fan_in 2")
    spark, step, leaf = points.sparkSession, signal == "step", leaf_of(bucket)
    end = lambda c: None if step else F.col(c)

    # Leaves: segments inside them lie in one bucket.
    inside = Window.partitionBy("key", "node").orderBy("t")
    rows = points.select("key", "t", "v", floor_div(F.col("t"), F.lit(leaf).cast("long")).alias("node"))
    rows = rows.withColumns({"gap": F.lead("t").over(inside) - F.col("t"), "w": F.lead("v").over(inside)})
    rows = rows.withColumn("cover", F.coalesce(covered(F.col("gap"), step, max_gap), F.lit(0)))
    area = F.when(F.col("cover") > 0, integral2(F.col("cover"), F.col("v"), end("w"), end("gap"))).otherwise(0)
    leaves = rows.groupBy("key", "node").agg(
        F.min("t").alias("first_t"), F.min_by("v", "t").alias("first_v"), F.max("t").alias("last_t"), F.max_by("v", "t").alias("last_v"), F.count("*").alias("n"), F.sum("cover").alias("covered"), F.sum(area).alias("area2")
    )
    path = scratch(spark, "resample-leaves")
    leaves.write.parquet(path)
    level = spark.read.parquet(path)
    totals = [level.select("key", (floor_div(F.col("first_t"), F.lit(bucket).cast("long")) * bucket).alias("bucket"), "n", "covered", "area2")]
    least, most = level.agg(F.min("node"), F.max("node")).first()
    span = 1 if least is None else most - least + 1
    level = level.withColumn("node", F.col("node") - F.lit(least or 0))

    pieces = lambda rows, column: rows.select("key", F.explode(column).alias("p")).select("key", "p.bucket", F.lit(0).cast("long").alias("n"), "p.covered", "p.area2")
    turn = 0
    while span > 1:
        span, turn = -(-span // fan_in), turn + 1
        among = Window.partitionBy("key", "parent").orderBy("node")
        rows = level.select("key", "node", "first_t", "first_v", "last_t", "last_v", F.call_function("div", F.col("node"), F.lit(fan_in).cast("long")).alias("parent"))
        rows = rows.withColumns({"gap": F.lead("first_t").over(among) - F.col("last_t"), "w": F.lead("first_v").over(among)})
        rows = rows.withColumn("cover", covered(F.col("gap"), step, max_gap))
        rows = rows.withColumn("segment", parts(F.col("last_t"), F.col("last_v"), end("w"), end("gap"), F.col("cover"), bucket))
        merged = rows.groupBy("key", "parent").agg(
            F.min("first_t").alias("first_t"), F.min_by("first_v", "first_t").alias("first_v"), F.max("last_t").alias("last_t"), F.max_by("last_v", "last_t").alias("last_v"), F.flatten(F.collect_list("segment")).alias("joined")
        )
        path = scratch(spark, f"resample-{turn}")
        merged.withColumnRenamed("parent", "node").write.parquet(path)
        level = spark.read.parquet(path)
        totals.append(pieces(level, "joined"))
    if step:
        tail = parts(F.col("last_t"), F.col("last_v"), None, None, F.lit(max_gap).cast("long"), bucket)
        totals.append(pieces(level, tail))

    every = totals[0]
    for more in totals[1:]:
        every = every.unionByName(more)
    out = every.groupBy("key", F.col("bucket").alias("bucket_start")).agg(F.sum("n").alias("n_points"), F.sum("covered").alias("covered_seconds"), F.sum("area2").alias("area2"))
    return out.withColumn("avg", F.when(F.col("covered_seconds") > 0, floor_div(F.col("area2"), 2 * F.col("covered_seconds"))))
