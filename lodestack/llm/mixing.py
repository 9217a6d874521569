"""Operator 8, mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the wanted corpus divided by its own size. Every document draws its
count of copies from a Poisson distribution with that mean, by inverting the distribution at a uniform number that is
hashed from seed and id; so counts need no state, and a lost task draws the same again. A mean over `part` is the sum of
equal means of at most `part`, drawn from as many hashes. Copies are exploded and dealt to partitions by a hash of
seed, id and copy, and sorted by it there: a global shuffle of the corpus in one exchange without sampling.

All expressions are built in. Rates are one row a source; they are broadcast up to `max_broadcast` sources, and
joined by a shuffle beyond (the skewed side of which Spark splits at run time). No key of the input decides where
copies go, so a hot source makes no hot partition.

Cases: a null source is a source of its own; null and empty texts have size 0, and a source of size 0 is kept once a
document (rate 1), unless weights are given and its own is 0; sources with weight 0 go, sources without a given weight have weight 0, so
weights of absent sources only leave nothing; very long texts are handed on as they are; a null id draws as the empty
text; repeated rows draw the same count each; earlier columns named as the outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import cut_lineage, partitions


def uniform(*parts: Column) -> Column:
    """52 bits of the md5 of the parts, joined by colons, as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """The cumulative distribution up to where 52 bits can't tell it from 1: its inverse at u is the number of entries <= u."""
    last = (F.ceil(mean + 12 * F.sqrt(mean)) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    folded = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf")),
    )
    return folded["cdf"]


def rates(docs: DataFrame, *, source_column: str, text_column: str, weights: dict[str, float] | None, temperature: float, epochs: float, part: float) -> DataFrame:
    """A row a source: src, mean (rate), draws (hashes a document) and steps (the distribution of one draw)."""
    sizes = docs.groupBy(F.col(source_column).alias("src")).agg(F.sum(F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighed = cut_lineage(sizes.withColumn("weight", weight))
    totals = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    total = totals.first()
    once = F.col("size") == 0
    if weights is not None:
        once = once & (F.col("weight") > 0)
    if not total["all_weight"]:
        mean = F.when(once, F.lit(1.0)).otherwise(0.0)
    else:
        share = F.lit(float(epochs)) * total["all_size"] * (F.col("weight") / total["all_weight"])
        mean = F.when(once, F.lit(1.0)).otherwise(F.when(F.col("size") > 0, share / F.col("size")).otherwise(0.0))
    out = weighed.select("src", mean.alias("mean")).filter("mean > 0")
    out = out.withColumn("draws", F.ceil(F.col("mean") / part).cast("int"))
    return out.withColumn("steps", poisson_steps(F.col("mean") / F.col("draws")))


def mix(
    docs: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: str = "mix",
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    part: float = 16.0,
    max_broadcast: int = 50_000,
) -> DataFrame:
    """All columns of the drawn copies, with copy (from 1) and shuffle_key, ordered by it within partitions.

    `weights` are shares of the wanted bytes by source (any scale); without them a source weighs its bytes to the power
    `temperature`. The corpus is wanted with `epochs` times the bytes it has.
    """
    docs = docs.drop(*({"copy", "shuffle_key"} - {id_column, source_column, text_column}))
    table = rates(docs, source_column=source_column, text_column=text_column, weights=weights, temperature=temperature, epochs=epochs, part=part)
    table = table.select(F.struct("src").alias("mix_source"), F.col("draws").alias("mix_draws"), F.col("steps").alias("mix_steps"))
    few = table.limit(max_broadcast + 1).count() <= max_broadcast
    table = F.broadcast(table) if few else table
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    joined = docs.withColumn("mix_source", F.struct(F.col(source_column).alias("src"))).join(table, "mix_source")
    # The number is bound once, and not hashed again for each step that it is compared with.
    drawn = lambda u: F.size(F.filter("mix_steps", lambda c: c <= u))
    draw = lambda j: F.element_at(F.transform(F.array(uniform(F.lit(seed), key, j.cast("string"))), drawn), 1)
    count = F.aggregate(F.sequence(F.lit(1), F.col("mix_draws")), F.lit(0), lambda acc, j: acc + draw(j))
    counted = joined.withColumn("mix_count", count).filter("mix_count > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    copies = copies.drop("mix_source", "mix_draws", "mix_steps", "mix_count")
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy").cast("string"), F.lit("order")).cast("binary")))
    return copies.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
