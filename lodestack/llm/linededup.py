"""Operator 5, line dedup by distinct-site spread.

A line is boilerplate if it stands on `min_sites` distinct sites or more, wherever it stands in their texts. HyperLogLog
sketches of sites are merged per line hash by aggregation, tasks first; lines whose estimate lies within `sigmas` standard
errors of the threshold get exact distinct counts; the rest is decided by the estimate.

A caller that must spare copies of documents, which repeat whole texts on many sites, gives `spread`: a line then also has to stand
in documents of different kinds, at least that share of those that have it. Documents are of one kind if the smallest hash of their
shingles of five words is the same, as it is for copies and nearly always for near copies, but not for texts that share a block.

Removal is exact on the 64-bit line hash. Up to `max_lookup` lines the hashes form a two-level array behind a scalar
subquery, and documents are cleaned where they are, without a shuffle; beyond that they are joined by line hash (rows of
narrow columns), gathered per document, and joined to the documents. In the same way, up to `max_lookup` lines near the
threshold (of 8 bytes each) are broadcast to count their sites; beyond that distinct (line, site) rows are joined. Both ways
give the same rows. All expressions are built in.

Cases: a null text stays null and loses nothing; an empty text is one blank line; blank lines are never removed, nor do
they count; lines are compared without the spaces around them; a null site is a site of its own; a text whose lines all go
becomes empty, and its row stays; repeated rows are treated alike; other columns pass through, but for earlier ones named
n_lines or n_removed, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import cut_lineage


def line_hashes(text: Column) -> Column:
    """Hash of each line without surrounding spaces, 0 for blank ones."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) == "", F.lit(0)).otherwise(F.xxhash64(F.trim(x))))


def spots(docs: DataFrame, site_column: str, text_column: str) -> DataFrame:
    """A row (h, site) for each distinct line of each text that isn't blank."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_column).cast("string")), F.lit(""))
    return docs.select(site.alias("site"), F.explode(F.array_distinct(line_hashes(F.col(text_column)))).alias("h")).filter("h <> 0")


def boilerplate(docs: DataFrame, *, min_sites: int = 5, site_column: str = "source", text_column: str = "text", lg_k: int = 12, sigmas: float = 3.0, max_lookup: int = 200_000) -> DataFrame:
    """Hashes (h) of the lines that stand on `min_sites` sites or more."""
    seen = spots(docs, site_column, text_column)
    error = sigmas * 1.04 / (2 ** (lg_k / 2))
    # Estimates are rounded to whole sites, hence the one site more on either side.
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    sketches = seen.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    estimates = cut_lineage(sketches.select("h", F.hll_sketch_estimate("sketch").alias("estimate")).filter(F.col("estimate") >= low))
    sure = estimates.filter(F.col("estimate") > high).select("h")
    near = estimates.filter(F.col("estimate") <= high).select("h")
    if near.count() <= max_lookup:
        pairs = seen.join(F.broadcast(near), "h", "left_semi").distinct()
    else:
        pairs = seen.distinct().join(near, "h", "left_semi")
    exact = pairs.groupBy("h").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.unionByName(exact.select("h"))


def remove_lines(docs: DataFrame, lines: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", max_lookup: int = 200_000) -> DataFrame:
    """All rows without the listed lines (column h), with n_lines and n_removed."""
    lines = cut_lineage(lines)
    n = lines.count()
    docs = docs.drop(*({"n_lines", "n_removed"} - {id_column, text_column}))
    text = F.col(text_column)
    if n <= max_lookup:
        slots = max(1, n // 4)
        buckets = lines.groupBy(F.pmod("h", F.lit(slots)).alias("slot")).agg(F.collect_list("h").alias("hs"))
        every = docs.sparkSession.range(slots).select(F.col("id").alias("slot")).join(buckets, "slot", "left")
        ordered = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))))
        lookup = cut_lineage(every.agg(F.transform(ordered, lambda x: x["hs"]).alias("hs"))).scalar()  # one row of max_lookup numbers at most
        docs = docs.withColumn("dedup_lookup", lookup)  # a subquery can't stand in a lambda function
        goes = lambda h: F.array_contains(F.element_at("dedup_lookup", (F.pmod(h, F.lit(slots)) + 1).cast("int")), h)
        listed = "dedup_lookup"
    else:
        key = F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"))
        hashes = docs.select(key.alias("dedup_key"), F.explode(F.array_distinct(line_hashes(text))).alias("h")).filter("h <> 0")
        gone = hashes.join(lines, "h", "left_semi").groupBy("dedup_key").agg(F.collect_set("h").alias("dedup_gone"))
        docs = docs.withColumn("dedup_key", key)
        docs = docs.join(gone, docs["dedup_key"].eqNullSafe(gone["dedup_key"]), "left").drop("dedup_key")
        goes = lambda h: F.array_contains("dedup_gone", h)
        listed = "dedup_gone"
    split = F.split(text, "\n", -1)
    kept = F.filter(split, lambda x: (F.trim(x) == "") | ~F.coalesce(goes(F.xxhash64(F.trim(x))), F.lit(False)))
    out = docs.withColumn("dedup_kept", kept)
    out = out.withColumns({
        text_column: F.array_join("dedup_kept", "\n"),
        "n_lines": F.when(text.isNull(), F.lit(0)).otherwise(F.size(split)),
        "n_removed": F.when(text.isNull(), F.lit(0)).otherwise(F.size(split) - F.size("dedup_kept")),
    })
    return out.drop("dedup_kept", listed)


def different(docs: DataFrame, lines: DataFrame, *, spread: float, text_column: str = "text", words: int = 5, max_lookup: int = 200_000) -> DataFrame:
    """Those of the lines (column h) for which documents of different kinds are at least the share `spread` of the documents that have them."""
    lines = cut_lineage(lines)
    text = F.col(text_column)
    # A generator between, so that a text is split once and not again for each shingle.
    parts = docs.filter(text.isNotNull()).select(F.explode(F.array(F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))).alias("ws"), F.array_distinct(line_hashes(text)).alias("hs"))
    shingles = F.when(F.size("ws") >= words, F.transform(F.sequence(F.lit(1), F.size("ws") - (words - 1)), lambda i: F.xxhash64(F.slice("ws", i, words)))).otherwise(F.array(F.xxhash64("ws")))
    rows = parts.select("hs", F.array_min(shingles).alias("kind")).select(F.explode("hs").alias("h"), "kind")
    few = lines.count() <= max_lookup
    per = rows.join(F.broadcast(lines) if few else lines, "h", "left_semi").groupBy("h", "kind").agg(F.count("*").alias("n"))
    counted = per.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("docs"))
    return counted.filter(F.col("kinds") >= spread * F.col("docs")).select("h")


def line_dedup(
    docs: DataFrame,
    *,
    min_sites: int = 5,
    site_column: str = "source",
    id_column: str = "doc_id",
    text_column: str = "text",
    lg_k: int = 12,
    max_lookup: int = 200_000,
    spread: float | None = None,
) -> DataFrame:
    """Remove the lines that `boilerplate` finds, and `different` where `spread` is given, from every text."""
    lines = boilerplate(docs, min_sites=min_sites, site_column=site_column, text_column=text_column, lg_k=lg_k, max_lookup=max_lookup)
    if spread is not None:
        lines = different(docs, lines, spread=spread, text_column=text_column, max_lookup=max_lookup)
    return remove_lines(docs, lines, id_column=id_column, text_column=text_column, max_lookup=max_lookup)
