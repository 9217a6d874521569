"""Hybrid search over chunks: words and vectors ranked for each vault, fused by rank, rescored, reranked, hydrated.

A chunk has vault, note, chunk (unique), text, vector, props (JSON), status, valid_from, valid_to, mtime. Rows that are superseded
or out of their validity are left out before any rank is given. Each list and each vault is cut by its own window, and the
windows keep a bounded number of rows a vault; what follows the global cut works on that many rows.

Orders end in (vault, chunk), so equal scores never depend on the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators import memory, retrieval
from lodestack.operators.postings import Index
from lodestack.operators.predicates import matches_text, not_superseded, valid_at
from lodestack.runtime import stored
from lodestack.sources.markdown import normal

#: Candidates of each list for each wanted hit, the pool of a reranker, the least characters that it reads, and the
#: candidates for each wanted hit where properties filter or boost, and where notes are wanted.
FAN, POOL, READABLE, BOOSTED, NOTES, MOST_NOTES = 3, 5, 20, 3, 4, 100
#: Hits for each wanted section, and hits that a recall looks at.
SECTIONS, RECALLED = 5, 200
#: Fused hits (a few numbers each) that are broadcast to the chunks.
MOST_SENT = 200_000


@dataclass(frozen=True)
class Condition:
    key: str
    value: str
    weight: float = 0.0


def visible(chunks: DataFrame, now: Column, *, superseded: bool = False, vaults: Sequence[str] | None = None) -> DataFrame:
    keep = valid_at("valid_from", "valid_to", now)
    if not superseded:
        keep = keep & not_superseded()
    if vaults is not None:
        keep = keep & F.col("vault").isin(*vaults) if vaults else F.lit(False)
    return chunks.filter(keep)


def first_of_vault(rows: DataFrame, n: int, *order: Column, name: str = "rank") -> DataFrame:
    place = F.row_number().over(Window.partitionBy("vault").orderBy(*order, F.col("chunk")))
    return rows.withColumn(name, place).filter(F.col(name) <= n)


def candidates(shown: DataFrame, index: Index, terms: Sequence[str], vector: Sequence[float] | None, n: int, rrf_k: int = 60) -> DataFrame:
    """vault, chunk, rrf, best_rank, text_rank, near_rank: the n best of each vault, fused from lists of FAN * n.

    All words of the query must stand in a chunk. Without a vector, and in a vault without vectors, words alone decide.
    """
    texts = index.bm25(terms, None, every=True, keep=shown.select(F.col("chunk").alias("key"))).select("vault", F.col("key").alias("chunk"), "score")
    lists = [first_of_vault(texts, FAN * n, F.desc("score")).select("vault", "chunk", "rank", F.lit("text").alias("list"))]
    if vector is not None:
        point = F.array(*[F.lit(float(x)) for x in vector])
        near = shown.filter(F.size("vector") == len(vector)).select("vault", "chunk", F.round(retrieval.l2(F.col("vector"), point), 6).alias("distance"))
        lists.append(first_of_vault(near, FAN * n, F.asc("distance")).select("vault", "chunk", "rank", F.lit("near").alias("list")))
    rows = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    ranks = [F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in ("text", "near")]
    fused = rows.groupBy("vault", "chunk").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("rrf"), F.min("rank").alias("best_rank"), *ranks)
    return first_of_vault(fused, n, F.desc("rrf"), F.col("best_rank"), name="place").drop("place")


def rerank(hits: DataFrame, query: str, scorer: Callable[[str, list[str]], Sequence[float]], k: int) -> DataFrame:
    """The k best of the pool by the scorer, then by score; chunks too short to read leave the pool, unless all are.

    A scorer that fails, or gives another number of scores, leaves the order as it was. It is called once for the pool, in one task.
    """
    readable = F.length(F.trim("text")) >= READABLE
    pool = hits.orderBy(F.desc("score"), "vault", "chunk").limit(k * POOL)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        read = group[group["readable"]]
        try:
            scores = list(scorer(query, read["text"].tolist())) if len(read) else []
            told = len(scores) == len(read) > 0
        except Exception:  # noqa: BLE001  a reranker is foreign code; the contract is to go on without it
            told = False
        if told:
            read = read.assign(rerank=[float(s) for s in scores])
        else:
            read = group.assign(rerank=float("nan"))
        return read[["vault", "chunk", "rerank"]]

    kinds = dict(hits.dtypes)
    scored = pool.select("vault", "chunk", "text", readable.alias("readable")).groupBy(F.lit(0).alias("one")).applyInPandas(lambda _, g: run(g), f"vault {kinds['vault']}, chunk {kinds['chunk']}, rerank double")
    out = pool.join(F.broadcast(scored), ["vault", "chunk"]).withColumn("rerank", F.nanvl("rerank", F.lit(None).cast("double")))  # k * POOL rows
    return out.orderBy(F.desc_nulls_last("rerank"), F.desc("score"), "vault", "chunk").limit(k)


def boosted(hits: DataFrame, boosts: Sequence[Condition], only: Sequence[Condition]) -> DataFrame:
    """Hits whose properties meet all of `only`, with the weights of the boosts that they meet added to score."""
    keep, extra = F.lit(True), F.lit(0.0)
    for c in only:
        keep = keep & matches_text("props", c.key, c.value)
    for c in boosts:
        extra = extra + F.when(matches_text("props", c.key, c.value), F.lit(c.weight)).otherwise(0.0)
    return hits.filter(keep).withColumn("score", F.round(F.col("score") + extra, 9))


def search(
    chunks: DataFrame,
    index: Index,
    terms: Sequence[str],
    vector: Sequence[float] | None,
    now: Column,
    *,
    k: int = 10,
    rrf_k: int = 60,
    vaults: Sequence[str] | None = None,
    superseded: bool = False,
    recency: float = 0.0,
    authority: float = 0.0,
    half_life: float = 30.0,
    boosts: Sequence[Condition] = (),
    only: Sequence[Condition] = (),
    scorer: Callable[[str, list[str]], Sequence[float]] | None = None,
    notes: bool = False,
) -> DataFrame:
    """The k best chunks of all vaults with their columns (but the vector), score and ranks; with `notes` the best of each note."""
    kept = chunks.filter(F.lit(False)) if k <= 0 or not terms else chunks
    shown = visible(kept, now, superseded=superseded, vaults=vaults)
    wanted = min(k * NOTES, max(k, MOST_NOTES)) if notes else k
    wanted *= BOOSTED if boosts or only else 1
    n = wanted * POOL if scorer else wanted
    fused = candidates(shown, index, terms, vector, n, rrf_k)
    # At most n rows a vault: they go to the chunks, whose texts then stay where they are, unless vaults are too many for that.
    fused = stored(fused, "fused")
    few = F.broadcast(fused) if fused.count() <= MOST_SENT else fused
    own = shown.drop("vector").join(few.select("chunk"), "chunk", "left_semi")  # goes below the joins that `chunks` may come from
    hits = own.join(few.withColumnRenamed("rrf", "score"), ["vault", "chunk"])
    if recency or authority:
        age = (now.cast("double") - F.col("mtime").cast("double")) / 86400
        sure = F.get_json_object("props", "$.authoritative") == "true"
        hits = hits.withColumn("score", F.round(retrieval.rescore(F.col("score"), age, sure, recency, authority, half_life), 9))
    if boosts or only:
        hits = boosted(hits, boosts, only)
    if notes:
        hits = retrieval.best_per(hits, ["vault", "note"], F.desc("score"), F.col("best_rank"), F.col("chunk"))
    if scorer:
        return rerank(hits, " ".join(terms), scorer, k)
    return hits.orderBy(F.desc("score"), "best_rank", "vault", "chunk").limit(max(k, 0))


def section_search(chunks: DataFrame, index: Index, terms: Sequence[str], vector: Sequence[float] | None, now: Column, sections: DataFrame, *, limit: int = 10, **options) -> DataFrame:
    """vault, note, section (low, high, heading), score, chunk: the best sections of SECTIONS * limit hits, each by its best chunk.

    `sections` has vault, note, low, high, heading; a hit counts for the narrowest one that holds its chunk, and hits outside all for none.
    """
    hits = search(chunks, index, terms, vector, now, k=limit * SECTIONS, **options).select("vault", "note", "chunk", "score", "text")
    held = hits.join(sections, ["vault", "note"]).filter((F.col("chunk") >= F.col("low")) & (F.col("chunk") <= F.col("high")))
    own = retrieval.best_per(held, ["vault", "chunk"], F.asc(F.col("high") - F.col("low")), F.asc("heading"))
    place = F.struct((-F.col("score")).alias("less"), "chunk", F.substr("text", F.lit(1), F.lit(200)).alias("snippet"))
    per = own.groupBy("vault", "note", "low", "high", "heading").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(place)).alias("places"))  # of limit * SECTIONS hits
    out = per.select("vault", "note", "low", "high", "heading", "score", F.transform("places", lambda p: p["chunk"]).alias("chunks"), F.col("places")[0]["snippet"].alias("snippet"))
    return out.orderBy(F.desc("score"), "vault", "note", "low", "heading").limit(limit)


def recall_search(chunks: DataFrame, index: Index, terms: Sequence[str], vector: Sequence[float] | None, now: Column, notes: DataFrame, *, sinks: Sequence[str], limit: int = 20, vaults: Sequence[str] | None = None, **filters) -> DataFrame:
    """What `memory.recall` makes of the RECALLED best hits of a search: notes (vault, note, path, status, confidence, type, observed_at,
    valid_from, valid_to, mtime) below the sinks. Superseded notes are left to its filters."""
    hits = search(chunks, index, terms, vector, now, k=RECALLED, superseded=True, vaults=vaults).select("vault", "note", "chunk", "score")
    return memory.recall(hits.join(notes, ["vault", "note"]), now, sinks=sinks, limit=limit, **filters)


def inject_alias(hits: DataFrame, query: str, aliases: DataFrame, chunks: DataFrame, now: Column, k: int, *, superseded: bool = False) -> DataFrame:
    """hits (vault, note, chunk, score) with `place` from 1: the note whose alias is the whole query comes first, as its best hit, or
    with its first chunk and score 1; k hits at most. `aliases` has vault, note, alias; the first vault wins, then the least note."""
    shown = visible(chunks, now, superseded=superseded).groupBy("vault", "note").agg(F.min("chunk").alias("chunk"))
    meant = aliases.filter(normal(F.col("alias")) == normal(F.lit(query))).join(shown, ["vault", "note"]).orderBy("vault", "note").limit(1)
    own = hits.join(F.broadcast(meant.select("vault", "note")), ["vault", "note"], "left_semi")  # one note
    best = own.orderBy(F.desc("score"), "chunk").limit(1).select("vault", "note", "chunk", "score", F.lit(0).alias("turn"))
    fresh = meant.select("vault", "note", "chunk", F.lit(1.0).alias("score"), F.lit(0).alias("turn")).join(own.select("vault", "note").distinct(), ["vault", "note"], "left_anti")
    rest = hits.select("vault", "note", "chunk", "score", F.lit(1).alias("turn")).join(best.select("vault", "chunk"), ["vault", "chunk"], "left_anti")
    every = best.unionByName(fresh).unionByName(rest).orderBy("turn", F.desc("score"), "vault", "chunk").limit(k)
    place = F.row_number().over(Window.orderBy("turn", F.desc("score"), "vault", "chunk"))  # k rows
    return every.select("vault", "note", "chunk", "score", place.alias("place"))


def with_neighbours(hits: DataFrame, expanded: DataFrame, seed: str) -> DataFrame:
    """hits with `neighbours`, the nodes that `expanded` (seed, node, hop, type) reached from each; ranks stay as they are."""
    near = expanded.groupBy(F.col("seed").alias(seed)).agg(F.array_sort(F.collect_list(F.struct("hop", "node", "type"))).alias("neighbours"))
    none = F.expr("cast(array() as array<struct<hop: int, node: bigint, type: string>>)")
    return hits.join(near, seed, "left").withColumn("neighbours", F.coalesce("neighbours", none))


def hydrate(hits: DataFrame, notes: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """hits after the cut with the columns of their note (vault, note, path, title) and, given sections (note, low, high, heading),
    the heading of the narrowest that holds the chunk. Notes and sections that no hit needs aren't read into the join."""
    out = hits.join(notes, ["vault", "note"], "left")
    if sections is None:
        return out
    held = hits.select("note", "chunk").join(sections, "note").filter((F.col("chunk") >= F.col("low")) & (F.col("chunk") <= F.col("high")))
    own = held.groupBy("note", "chunk").agg(F.min_by("heading", F.struct(F.col("high") - F.col("low"), "heading")).alias("heading"))
    return out.join(own, ["note", "chunk"], "left")


def citation(hits: DataFrame, scheme: str = "store") -> DataFrame:
    """The packet that a hit is cited by: id, source, title, path, hash, mtime, score, snippet, with status and successor where they are."""
    source = F.concat(F.lit(f"{scheme}://"), F.col("vault"))
    return hits.select(
        F.concat(source, F.lit("/"), "path").alias("doc_id"), source.alias("source"), "title", "path", F.sha2("text", 256).alias("hash"), "mtime", "score",
        F.substr("text", F.lit(1), F.lit(200)).alias("snippet"), F.when(F.col("status") == "superseded", F.col("status")).alias("status"), F.when(F.col("status") == "superseded", F.col("superseded_by")).alias("superseded_by"),
    )
