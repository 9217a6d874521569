"""The verbs of workflows, bound to the operators: what a step may call, over one library of tables.

Each verb gives a mapping with `rows` (a lazy DataFrame) and `doc_ids` (a DataFrame of one column id); where a verb takes ids, it
takes such a DataFrame or a list. So a step's ids go on to the next one without leaving Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import briefs, edges, graph, hybrid, outline, predicates, records
from lodestack.operators.postings import Index

#: The verbs that a workflow may call besides `literal` and those of peers.
NAMES = ("search_hybrid", "expand", "cluster", "recall", "compile_brief", "get_brief", "query_frontmatter", "list_backlinks", "get_outline", "search_sections", "read_note")
METHODS = ("edge-community",)


@dataclass
class Library:
    """Tables of a collection: notes (id, vault, note, path, title, props, hash, mtime, status, type, confidence, observed_at, valid_from,
    valid_to), chunks (as `hybrid` has them), edges (src, dst, type of note ids), sections (vault, note, id, parent, pos, level, low, high, heading),
    briefs (target, brief, compiled_at, superseded, stale). `vector` embeds a query, `now` is the clock."""

    spark: SparkSession
    notes: DataFrame
    chunks: DataFrame
    index: Index
    edges: DataFrame
    sections: DataFrame
    briefs: DataFrame
    now: Column
    sinks: Sequence[str] = ()
    vaults: Sequence[str] = ()
    vector: Callable[[str], Sequence[float] | None] = field(default=lambda text: None)

    def verbs(self) -> dict[str, Callable[..., Any]]:
        return {name: getattr(self, name) for name in NAMES}

    def _ids(self, ids: DataFrame | Sequence[Any], name: str = "id") -> DataFrame:
        kind = self.notes.schema["id"].dataType.simpleString()
        rows = ids.select(F.col("id").cast(kind).alias(name)) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(x,) for x in ids], f"{name} {kind}")
        return rows.distinct()

    def _told(self, rows: DataFrame, ids: DataFrame, **more: Any) -> dict[str, Any]:
        return {"rows": rows, "doc_ids": ids.select("id").distinct(), **more}

    def _notes_of(self, rows: DataFrame) -> DataFrame:
        return self.notes.join(rows.select("vault", "note").distinct(), ["vault", "note"], "left_semi")

    def _vaults(self, vault: str | None) -> list[str] | None:
        if vault is not None and vault not in self.vaults:
            raise ValueError(f"vault_required: name one of {', '.join(self.vaults)}")
        return [vault] if vault is not None else None

    def read_note(self, doc_id: Any) -> dict[str, Any]:
        rows = self.notes.join(F.broadcast(self._ids([doc_id])), "id", "left_semi")  # one id
        return self._told(rows, rows)

    def search_hybrid(self, query: str, vault: str | None = None, limit: int = 10) -> dict[str, Any]:
        rows = hybrid.search(self.chunks, self.index, query.lower().split(), self.vector(query), self.now, k=limit, vaults=self._vaults(vault))
        return self._told(rows, self._notes_of(rows))

    def search_sections(self, query: str, vault: str | None = None, limit: int = 10) -> dict[str, Any]:
        rows = hybrid.section_search(self.chunks, self.index, query.lower().split(), self.vector(query), self.now, self.sections.select("vault", "note", "low", "high", "heading"), limit=limit, vaults=self._vaults(vault))
        return self._told(rows, self._notes_of(rows))

    def recall(self, query: str, vault: str | None = None, limit: int = 20, confidence: str | None = None, types: Sequence[str] | None = None, max_age_days: float | None = None) -> dict[str, Any]:
        known = self.notes.select("vault", "note", "id", "path", "status", "confidence", "type", "observed_at", "valid_from", "valid_to", "mtime")
        rows = hybrid.recall_search(self.chunks, self.index, query.lower().split(), self.vector(query), self.now, known, sinks=self.sinks, limit=limit, vaults=self._vaults(vault), confidence=confidence, types=types, days=max_age_days)
        return self._told(rows, rows)

    def expand(self, seed_doc_ids: DataFrame | Sequence[Any], hops: int = 1, direction: str = "both") -> dict[str, Any]:
        seeds = self._ids(seed_doc_ids, "seed")
        rows = graph.expand(self.edges, seeds, hops, direction)
        return self._told(rows, seeds.select(F.col("seed").alias("id")).unionByName(rows.select(F.col("node").alias("id"))))

    def cluster(self, seed_doc_ids: DataFrame | Sequence[Any] | None = None, query: str | None = None, vault: str | None = None, method: str = "edge-community", query_top_k: int = 10, force: bool = False) -> dict[str, Any]:
        if method not in METHODS:
            raise ValueError(f"{method!r} is no method")
        given = None if seed_doc_ids is None else self._ids(seed_doc_ids, "seed")
        search = lambda v, text, top: self.search_hybrid(text, v, top)["doc_ids"].select(F.col("id").alias("node"))
        seeds = edges.seeds_of(seeds=given, asked=query, search=search, vaults=self.vaults, vault=vault, top=query_top_k)
        rows = edges.cluster(self.edges, seeds, force=force)
        return self._told(rows, rows.select(F.col("node").alias("id")))

    def compile_brief(self, target: str, source_doc_ids: DataFrame | Sequence[Any], purpose: str = "", vault: str | None = None, max_tokens: int = 2000) -> dict[str, Any]:
        """The sources' hashes, and a body of their titles as citations; `rows` has the error, if there is one."""
        self._vaults(vault)
        asked = self._ids(source_doc_ids).select(F.lit(target).alias("brief"), "id")
        rows = records.compile_briefs(asked, self.notes)
        cited = asked.join(self.notes, "id").orderBy("path").limit(records.MOST_SOURCES)
        body = cited.agg(F.concat(F.lit(f"# {purpose}\n\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "path", F.lit("]] "), "title"))), "\n")).alias("body"))
        return self._told(rows, asked, body=body.select(F.substr("body", F.lit(1), F.lit(4 * max_tokens)).alias("body")), target=target)

    def get_brief(self, target: str, max_age_days: float = 30) -> dict[str, Any]:
        rows = briefs.latest_briefs(self.briefs.filter(F.col("target") == target), "target", "brief", self.now, max_age_days)
        return {"rows": rows, "target": target}

    def query_frontmatter(self, where: Mapping[str, Any] | None = None, limit: int = 100) -> dict[str, Any]:
        rows = predicates.query_props(self.notes, "props", dict(where or {}), "mtime", "id", limit)
        return self._told(rows, rows)

    def list_backlinks(self, doc_id: Any) -> dict[str, Any]:
        rows = self.edges.join(F.broadcast(self._ids([doc_id], "dst")), "dst", "left_semi")  # one id
        return self._told(rows, rows.select(F.col("src").alias("id")))

    def get_outline(self, doc_id: Any) -> dict[str, Any]:
        own = self.read_note(doc_id)["rows"].select("vault", "note", "id")
        of = lambda df: df.join(own.select("vault", "note"), ["vault", "note"], "left_semi").withColumn("note", F.struct("vault", "note"))
        rows = outline.outline(of(self.sections).drop("vault"), of(self.chunks.select("vault", "note", "chunk")))
        return self._told(rows, own)
