"""Catching up: what changed in a folder of notes while no stream was running, brought into the stored index as one segment.

The index's manifest names the table of hashes (path, hash) that its last catch-up saw, and both change in one commit: after a crash
either all of it counts or nothing, and running it again goes on from what counts. Notes that moved are told apart from new ones by
their hash, so that callers can keep their ids.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.postings import Index


@dataclass(frozen=True)
class Caught:
    """How many notes were new, changed, gone and moved (these count as new and gone too)."""

    new: int
    changed: int
    gone: int
    moved: int


def known(index: Index) -> DataFrame:
    """path, hash as the last catch-up left them; none before the first."""
    place = index.view().content.get("known")
    schema = "path string, hash string"
    return index.spark.read.schema(schema).parquet(f"{index.path}/known/{place}") if place else index.spark.createDataFrame([], schema)


def compared(notes: DataFrame, seen: DataFrame) -> DataFrame:
    """path, change (new, changed, gone), old_path: of a new note the path of a gone one with the same hash, the smallest of them."""
    both = notes.select("path", F.col("hash").alias("now")).join(seen.select("path", F.col("hash").alias("was")), "path", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    rows = both.withColumn("change", change).filter("change is not null")
    gone = rows.filter("change = 'gone'").groupBy(F.col("was").alias("now")).agg(F.min("path").alias("old_path"))
    left = rows.join(gone, "now", "left")
    return left.select("path", "change", F.when(F.col("change") == "new", F.col("old_path")).alias("old_path"))


def catch_up(index: Index, notes: DataFrame, text: str = "body") -> Caught:
    """Bring the index (keyed by path) to the notes (path, hash, and a text column), as a parse of the folder gives them."""
    base = index.view()
    place = uuid.uuid4().hex
    seen = known(index)
    changes = compared(notes, seen)
    path = f"{index.path}/changes/{place}"
    changes.write.parquet(path)  # read three times below, and the folder may change meanwhile
    changes = index.spark.read.schema(changes.schema).parquet(path)
    counts = {r["change"]: (r["n"], r["moved"]) for r in changes.groupBy("change").agg(F.count("*").alias("n"), F.count("old_path").alias("moved")).collect()}
    told = Caught(*(counts.get(k, (0, 0))[0] for k in ("new", "changed", "gone")), counts.get("new", (0, 0))[1])
    if counts:
        fresh = notes.join(changes.filter("change <> 'gone'").select("path"), "path", "left_semi")
        held = seen.join(changes.select("path"), "path", "left_anti").unionByName(fresh.select("path", "hash"))
        held.write.parquet(f"{index.path}/known/{place}")
        index.replace(fresh, changes.filter("change = 'gone'").select(F.col("path").alias("key")), "path", text, base=base, noted={"known": place})
    index.manifest.fs.delete(index.manifest._path(path), True)
    return told
