"""Assembly of documents: band joins to sections, character budgets, rollups, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enclosing(points: DataFrame, bands: DataFrame, key: str, point: str, low: str, high: str, name: str) -> DataFrame:
    """The narrowest band of the same key that holds each point: an equi join on the key, then one row a point."""
    held = points.join(bands, key).filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high)))
    rank = F.row_number().over(Window.partitionBy(key, point).orderBy(F.col(high) - F.col(low), name))
    return held.withColumn("r", rank).filter("r = 1").drop("r")


def innermost(points: DataFrame, bands: DataFrame, key: str, point: str, low: str, high: str, name: str) -> DataFrame:
    """points with `name` of the innermost band of their key that holds them, null where none does; both bounds belong to a band.

    Bands of a key are nested or apart, as sections are; of equal ones the smallest name is the innermost. A sweep over sorted bounds and points
    by two windows, in place of all points with all bands of a key: the first counts the bands that are open, and the innermost of d
    open bands is the last that opened as the d-th. Nothing is gathered, and work grows with the rows, times the logarithm for sorting.
    """
    kind = bands.schema[name].dataType
    none = F.lit(None)
    # Rows are sorted twice in a task, so they are narrow: what points have besides is carried once, and the step is told by the turn.
    rest = [c for c in points.columns if c not in (key, point)]
    own = [F.struct(*rest).alias("own")] if rest else []
    rows = points.select(F.col(key).alias("k"), F.col(point).alias("at"), F.lit(1).alias("turn"), none.cast("long").alias("less"), none.cast(kind).alias("name"), *own)
    empty = [none.cast(rows.schema["own"].dataType).alias("own")] if rest else []
    side = lambda at, turn, less: bands.select(F.col(key).alias("k"), F.col(at).alias("at"), F.lit(turn).alias("turn"), less.cast("long").alias("less"), F.col(name).alias("name"), *empty)
    every = rows.unionByName(side(low, 0, -F.col(high))).unionByName(side(high, 2, none))
    order = ["at", "turn", "less", F.desc("name")]
    opened = F.sum(1 - F.col("turn")).over(Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(F.col("turn") == 0, F.col("name")), ignorenulls=True).over(Window.partitionBy("k", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = every.withColumn("depth", opened).filter("turn < 2").withColumn("held", F.when(F.col("depth") > 0, last)).filter("turn = 1")
    given = {key: F.col("k"), point: F.col("at")}
    columns = [given[c].cast(points.schema[c].dataType).alias(c) if c in given else F.col(f"own.`{c}`").alias(c) for c in points.columns]
    return swept.select(*columns, F.col("held").alias(name))


def budget(df: DataFrame, group: list[str], order: list[Column], text: str, limit: int) -> DataFrame:
    """Cut texts in order at a shared budget of characters: taken (length) and included. The texts stay out of the window's exchange,
    unless the result is asked for them: only their lengths are added up."""
    sized = df.withColumn("budget_size", F.length(text))
    before = F.coalesce(F.sum("budget_size").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(limit) - before)
    return sized.withColumns({"taken": F.least("budget_size", left).cast("long"), "included": left > 0}).drop("budget_size")


def histogram(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Count of each value per group, missing values as 'unknown'."""
    return df.groupBy(*group, F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def classify_changes(old: DataFrame, new: DataFrame, key: str, body: str, props: str) -> DataFrame:
    """key, change: new, deleted, body, properties or unchanged."""
    o = old.select(F.col(key), F.col(body).alias("old_body"), F.col(props).alias("old_props"), F.lit(1).alias("in_old"))
    n = new.select(F.col(key), F.col(body).alias("new_body"), F.col(props).alias("new_props"), F.lit(1).alias("in_new"))
    change = (
        F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(~F.col("old_body").eqNullSafe(F.col("new_body")), "body").when(~F.col("old_props").eqNullSafe(F.col("new_props")), "properties").otherwise("unchanged")
    )
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def stale_sources(recorded: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Recorded (brief, key, hash) whose current hash is missing or another."""
    now = current.select(key, F.col("hash").alias("now_hash"))
    return recorded.join(now, key, "left").filter(F.col("now_hash").isNull() | (F.col("now_hash") != F.col("hash"))).drop("now_hash")


def prevalence(properties: DataFrame, group: str, key: str, value: str, members: DataFrame) -> DataFrame:
    """Per group and key: presence, prevalence among the group's members, and the value that over half of those present have."""
    per = properties.groupBy(group, key, value).agg(F.count("*").alias("n"))
    top = per.groupBy(group, key).agg(F.sum("n").alias("present"), F.max(F.struct("n", value)).alias("top"))
    out = top.join(members, group)
    dominant = F.when(F.col("top.n") / F.col("present") > 0.5, F.col(f"top.{value}"))
    return out.select(group, key, "present", F.round(F.col("present") / F.col("members"), 6).alias("prevalence"), dominant.alias("dominant"))


def drift(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """field, issue: missing, type_changed or unexpected; both inputs are (field, kind)."""
    e, o = expected.withColumnRenamed("kind", "want"), observed.withColumnRenamed("kind", "have")
    issue = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "type_changed")
    return e.join(o, "field", "full_outer").select("field", issue.alias("issue")).filter(F.col("issue").isNotNull())
