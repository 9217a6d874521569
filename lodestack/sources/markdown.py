"""Markdown sources: a folder scan, note parsing (properties, links, sections), and link resolution."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import hashing
from lodestack.functions import text as md
from lodestack.operators.predicates import matches_any_glob

#: Folders that a scan leaves out.
EXCLUDED = (".obsidian/**", ".trash/**", "node_modules/**")
FRONT = re.compile(r"\A---[ \t]*\n(.*?)(?:\n)?---[ \t]*(?:\n|\Z)", re.S)
NOTE = (
    "struct<title: string, properties: string, body: string, n_words: int, hash: string, body_hash: string, "
    "links: array<struct<target: string, anchor: string, alias: string, line: int>>, "
    "sections: array<struct<ord: int, level: int, path: array<string>, start: int, end: int, anchor: string>>>"
)


def scan(spark: SparkSession, root: str, exclude: Sequence[str] = EXCLUDED) -> DataFrame:
    """path (below root), mtime and text of each Markdown file, but those that a glob excludes. Spark's file readers pass over
    files without a byte; `vault.notes` reads these too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = F.lit(re.sub(r"^\w+:(//[^/]*)?", "", root).rstrip("/") + "/")
    path = F.substr(F.col("path"), F.instr("path", base) + F.length(base))
    rows = files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n")).alias("text"))
    return rows.filter(~matches_any_glob(F.col("path"), exclude))


def front_matter(text: str) -> tuple[dict, str]:
    """Properties and body; what isn't a mapping, or can't be read, counts as no properties."""
    found = FRONT.match(text)
    if not found:
        return {}, text
    import yaml

    try:
        value = yaml.safe_load(found[1])
    except yaml.YAMLError:
        value = None
    return (value if isinstance(value, dict) else {}), text[found.end() :]


def sections(body: str) -> list[dict]:
    """A row for what stands before the first heading (level 0, unless blank), and one for each heading up to the next of its level or above."""
    heads, paths = md.headings(body), md.heading_paths(body)
    rows = [(0, [], 0, heads[0][0] if heads else len(body), 0)]
    for i, ((at, level, _), (_, path)) in enumerate(zip(heads, paths, strict=True)):
        end = next((a for a, other, _ in heads[i + 1 :] if other <= level), len(body))
        start = body.find("\n", at)
        rows.append((level, path, at, end, len(body) if start < 0 else start + 1))
    out = []
    for level, path, start, end, inner in rows:
        if level or body[start:end].strip():
            own = next((a for a, _, _ in heads if a > start or (not level and a >= start)), len(body))
            anchor = hashing.section_anchor(path[-1] if path else "", body[min(inner, own) : own])
            out.append({"ord": len(out), "level": level, "path": path, "start": start, "end": end, "anchor": anchor})
    return out


def note(path: str, text: str) -> dict:
    properties, body = front_matter(text)
    title = next((t for _, level, t in md.headings(body) if level == 1 and t), None) or path.rpartition("/")[2].removesuffix(".md")
    links = md.wikilinks(body)
    for m in md.WIKILINK.finditer(hashing.canonical_json({k: v for k, v in properties.items() if k not in ("alias", "aliases")})):
        if m[1].strip() and m[1].strip() not in {x["target"] for x in links}:
            links.append({"target": m[1].strip(), "anchor": m[2], "alias": m[3], "line": 0})
    return {
        "title": title, "properties": hashing.canonical_json(properties), "body": body, "n_words": len(body.split()), "hash": hashing.note_hash(body, properties),
        "body_hash": hashing.digest(body), "links": links, "sections": sections(body),
    }


def parse(files: DataFrame) -> DataFrame:
    """The scan's rows with the columns of NOTE, in one Arrow call a batch; a null text is empty."""

    def run(path: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([note(p or "", t or "") for p, t in zip(path, text, strict=True)], columns=["title", "properties", "body", "n_words", "hash", "body_hash", "links", "sections"])

    return files.withColumn("note", F.pandas_udf(run, NOTE)("path", "text")).select(*(c for c in files.columns if c != "text"), "note.*")


def normal(name: Column) -> Column:
    return F.lower(F.trim(name))


def resolve(links: DataFrame, notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """links (target, ...) with `resolved`, the id of the note meant: the path with or without .md; else, for a target without a
    folder, the file name anywhere; else an alias. The shortest path wins, then the first in order; null where nothing fits.

    `notes` has id and path, `aliases` id and alias. Each lookup has one row a key, so the joins add no rows.
    """
    first = F.min_by("id", F.struct(F.length("path"), "path", "id"))
    stem = F.regexp_replace("path", r"\.md$", "")
    by_path = notes.groupBy(stem.alias("key1")).agg(first.alias("by_path"))
    by_name = notes.groupBy(F.substring_index(stem, "/", -1).alias("key2")).agg(first.alias("by_name"))
    by_alias = aliases.join(notes, "id").groupBy(normal(F.col("alias")).alias("key3")).agg(first.alias("by_alias"))
    target = F.regexp_replace("target", r"\.md$", "")
    keyed = links.withColumns({"key1": target, "key2": F.when(~F.contains("target", F.lit("/")), target), "key3": normal(F.col("target"))})
    out = keyed.join(by_path, "key1", "left").join(by_name, "key2", "left").join(by_alias, "key3", "left")
    return out.select(*links.columns, F.coalesce("by_path", "by_name", "by_alias").alias("resolved"))
