"""Retrieval: BM25 over postings, exact nearest neighbours, reciprocal-rank fusion and rescoring.

Filters come before every limit, texts are joined after it, and all orders end in a unique key. Scores are rounded to six
digits, so that they don't depend on the order of additions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    """Lower-case alphanumeric words (ASCII letters and digits, others divide)."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bm25(docs: DataFrame, query: Sequence[str], key: str, text: str, k: int, keep: Column | None = None) -> DataFrame:
    """The k best documents for the query's words: key, score. `keep` filters what is returned, not the statistics.

    Only postings of the query's words are made: one scan, a map-side count of each word's documents and lengths.
    """
    query = sorted(set(query))
    # A generator between, since a filter on counts would else be pushed below and split every text again for each word.
    body = docs.select(key, F.explode(F.array(words(F.col(text)))).alias("ws"), (keep if keep is not None else F.lit(True)).alias("keep"))
    times = lambda q: F.size(F.filter("ws", lambda w: w == F.lit(q)))
    tf = [times(q).alias(f"tf{i}") for i, q in enumerate(query)]
    counted = body.select(key, "keep", F.size("ws").alias("len"), *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    joined = counted.filter("keep").filter(F.greatest(*[F.col(f"tf{i}") for i in range(len(query))], F.lit(0)) > 0).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(query)):
        n, df, f = F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + F.when(df > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(0.0)
    return joined.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def l2(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, query: Sequence[float], key: str, vector: str, k: int, keep: Column | None = None) -> DataFrame:
    """The k nearest vectors by L2 distance, filtered before the cut."""
    point = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(keep) if keep is not None else vectors
    rows = rows.filter(F.size(vector) == len(query))
    return rows.select(key, F.round(l2(F.col(vector), point), 6).alias("distance")).orderBy("distance", key).limit(k)


def rrf(rankings: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Fuse rankings (key, rank): rrf, best_rank. A list that misses a key adds nothing."""
    union = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select(key, "rank"))
    return union.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min("rank").alias("best_rank"))


def ranked(df: DataFrame, *order: Column, partition: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def rescore(score: Column, age_days: Column, authoritative: Column, recency: float, authority: float, half_life: float) -> Column:
    """score + recency * exp(-age / half_life) + authority where authoritative; ages below 0 count as 0."""
    if not recency and not authority:
        return score
    fresh = F.exp(-F.greatest(age_days, F.lit(0.0)) / half_life)
    return score + recency * F.coalesce(fresh, F.lit(0.0)) + F.when(F.coalesce(authoritative, F.lit(False)), authority).otherwise(0.0)


def best_per(df: DataFrame, group: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return ranked(df, *order, partition=group).filter("rank = 1").drop("rank")
