"""Briefs, section search and property suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators import assembly

#: What a suggestion from neighbours weighs, and the least confidence that is told.
NEIGHBOUR, LEAST = 0.6, 0.2


def latest_briefs(briefs: DataFrame, target: str, brief: str, now: Column, max_days: float) -> DataFrame:
    """target, brief, state of the newest brief that isn't superseded: stale before too_old before ok. Rows have compiled_at,
    superseded and stale (booleans, null as false); ties go to the smaller brief."""
    rows = briefs.filter(~F.coalesce("superseded", F.lit(False)))
    newest = rows.groupBy(target).agg(F.min_by(F.struct(brief, "compiled_at", "stale"), F.struct((-F.unix_micros("compiled_at")).alias("age"), brief)).alias("b"))
    days = F.floor((F.unix_micros(now) - F.unix_micros("b.compiled_at")) / 86_400_000_000)
    state = F.when(F.coalesce("b.stale", F.lit(False)), "stale").when(days > max_days, "too_old").otherwise("ok")
    return newest.select(target, f"b.{brief}", state.alias("state"))


def section_hits(hits: DataFrame, sections: DataFrame, key: str, point: str, low: str, high: str, name: str, limit: int) -> DataFrame:
    """The best sections of the hits (key, point, score): each hit's narrowest section, its best score, the first such point."""
    placed = assembly.enclosing(hits, sections, key, point, low, high, name)
    best = placed.groupBy(key, name).agg(F.max("score").alias("score"), F.min_by(point, F.struct((-F.col("score")).alias("s"), point)).alias(point))
    return best.orderBy(F.desc("score"), key, name).limit(limit)


def suggest(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """note, key, value, confidence, verdict of candidates (note, key, value, origin, confidence).

    Candidates of neighbours weigh less; each value counts with its strongest origin, and weak ones are left out. `present` has
    note, key, value: the verdict is existing for a value there, conflict where the key has another value or the candidates
    differ, else suggestion.
    """
    weight = F.when(F.col("origin") == "neighbor", F.col("confidence") * NEIGHBOUR).otherwise(F.col("confidence"))
    told = candidates.groupBy("note", "key", "value").agg(F.max(weight).alias("confidence")).filter(F.col("confidence") >= LEAST)
    several = told.groupBy("note", "key").agg((F.count("*") > 1).alias("several"))
    has = present.groupBy("note", "key").agg(F.collect_set("value").alias("has"))
    verdict = F.when(F.array_contains("has", F.col("value")), "existing").when(F.col("has").isNotNull() | F.col("several"), "conflict").otherwise("suggestion")
    joined = told.join(several, ["note", "key"]).join(has, ["note", "key"], "left")
    return joined.select("note", "key", "value", "confidence", verdict.alias("verdict"))
