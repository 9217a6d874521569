"""Outlines, bundles and dossiers: what a document consists of, what is around it, and what is known of a subject.

Sections have note, id, parent (null at the top), pos, level, path, low, high: chunks or lines from low to high are theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a snippet, and the edits that a bundle tells of.
SNIPPET, RECENT = 200, 10


def ordinals(sections: DataFrame) -> DataFrame:
    """sections with `ord`, the place from 0 among those of the same note and parent."""
    place = F.row_number().over(Window.partitionBy("note", "parent").orderBy("pos", "id")) - 1
    return sections.withColumn("ord", place)


def deepest(points: DataFrame, sections: DataFrame, point: str, by: Column) -> DataFrame:
    """points (note, ...) with `section`, the id of the section that holds the point, of several the one with the greatest `by`."""
    keyed = points.withColumn("spot", F.struct("note", point))
    held = keyed.select("note", point, "spot").distinct().join(sections, "note").filter((F.col(point) >= F.col("low")) & (F.col(point) <= F.col("high")))
    own = held.groupBy("spot").agg(F.max_by("id", F.struct(by.alias("by"), "id")).alias("section"))
    return keyed.join(own, "spot", "left").drop("spot")


def outline(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each section with the ids of the chunks (note, chunk) in its range, those at the top first, then by parent and place.

    The rows of a note are a tree by (id, parent); a section without a range has no chunks.
    """
    placed = ordinals(sections)
    inside = placed.select("note", "id", "low", "high").join(chunks.select("note", "chunk"), "note").filter((F.col("chunk") >= F.col("low")) & (F.col("chunk") <= F.col("high")))
    held = inside.groupBy("note", "id").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))
    out = placed.join(held, ["note", "id"], "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(held.schema["chunks"].dataType)))
    return out.orderBy("note", F.asc_nulls_first("parent"), "ord")


def tree(rows: list) -> list[dict]:
    """One note's outline rows, in order, as nested nodes; a row whose parent isn't there stands at the top."""
    nodes = {r["id"]: r.asDict() | {"children": []} for r in rows}
    top = []
    for r in rows:
        home = nodes.get(r["parent"])
        (home["children"] if home else top).append(nodes[r["id"]])
    return top


def snippet(text: Column) -> Column:
    """The start of the plain text, white space as single spaces."""
    return F.substr(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(1), F.lit(SNIPPET))


def bundle(note: str, notes: DataFrame, sections: DataFrame, chunks: DataFrame, edges: DataFrame, audit: DataFrame) -> dict[str, DataFrame]:
    """What belongs to a note (its id): anchor, outline, backlinks, forward links (target null where broken) and its latest edits.

    notes: id, title, text; chunks: note, chunk; edges: src, dst, target, type; audit: id, note, op, at. Each part is one narrow filter away
    from its table, so none reads more than that note's rows.
    """
    own = notes.filter(F.col("id") == note)
    other = notes.select("id", "title")
    back = edges.filter(F.col("dst") == note).join(other, F.col("src") == F.col("id")).select("src", "title", "type").distinct()
    ahead = edges.filter(F.col("src") == note).join(other, F.col("dst") == F.col("id"), "left").select("dst", "target", "title", "type").distinct()
    edits = audit.filter(F.col("note") == note).orderBy(F.desc("at"), F.desc("id")).limit(RECENT)
    return {
        "anchor": own.select("id", "title", snippet(F.col("text")).alias("snippet")),
        "outline": outline(sections.filter(F.col("note") == note), chunks.filter(F.col("note") == note)),
        "backlinks": back, "forward": ahead, "edits": edits,
    }


def anchors(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """type, key, id for each subject asked for (type, key): the note of just that type whose title or an alias is the key.

    Of several the first by title, then id; id is null, and `error` is no_anchor, where there is none. notes: id, type, title, aliases.
    """
    names = notes.select("id", "type", "title", F.explode(F.array_distinct(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("key"))
    first = names.join(asked, ["type", "key"], "left_semi").groupBy("type", "key").agg(F.min_by("id", F.struct("title", "id")).alias("id"))
    return asked.join(first, ["type", "key"], "left").withColumn("error", F.when(F.col("id").isNull(), "no_anchor"))


def dossier(anchor: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """For each anchor (id): linked, the notes that link to it, superseded ones included; and their counts by type and by status.

    A link counts once a note; a missing type or status is unknown. notes: id, type, status.
    """
    linking = edges.select("src", F.col("dst").alias("id")).distinct().join(anchor.filter("id is not null").select("id").distinct(), "id", "left_semi")
    of = linking.join(notes.select(F.col("id").alias("src"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("status", F.lit("unknown")).alias("status")), "src")
    linked = of.groupBy("id").agg(F.count("*").alias("linked"))
    for c in ("type", "status"):
        per = of.groupBy("id", c).agg(F.count("*").alias("n")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col(c).alias("value"), "n"))).alias(f"{c}s"))
        linked = linked.join(per, "id")
    return anchor.join(linked, "id", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
