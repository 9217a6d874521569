"""Change feeds as streams: reading events, debounce per key, own-write suppression, rename inference, idempotent publishing.

Events are (kind, id, at), with kind create, update or delete. State is bounded by the watermark on `at`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "kind string, id string, at timestamp"


def changes(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int = 1000) -> DataFrame:
    """Events of Markdown notes, as Parquet files of them arrive in the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).filter(F.col("id").endswith(".md"))


def debounce(events: DataFrame, quiet_ms: int = 500, most_ms: int = 5000, late: str = "10 seconds") -> DataFrame:
    """One event a key after `quiet_ms` without another, or `most_ms` after its first; the last kind wins (id, kind, at, n)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, kind, n = state.get if state.exists else (None, None, None, 0)
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["at", "kind"])
            for at, what in zip(rows["at"].astype("datetime64[ms]").astype("int64"), rows["kind"], strict=True):
                if n and (at - last >= quiet_ms or at - first >= most_ms):
                    out.append((key[0], kind, last, n))
                    first, n = None, 0
                first = at if first is None else first
                last, kind, n = (at if last is None else max(at, last)), what, n + 1
            state.update((first, last, kind, n))
            # A timeout must lie beyond the watermark, whatever late rows came in.
            state.setTimeoutTimestamp(max(min(last + quiet_ms, first + most_ms), state.getCurrentWatermarkMs() + 1))
        else:
            out.append((key[0], kind, last, n))
            state.remove()
        frame = pd.DataFrame(out, columns=["id", "kind", "at", "n"])
        frame["at"] = pd.to_datetime(frame["at"], unit="ms")
        yield frame

    keyed = events.select("id", "kind", "at").withWatermark("at", late).groupBy("id")
    return keyed.applyInPandasWithState(run, "id string, kind string, at timestamp, n long", "first long, last long, kind string, n long", "append", GroupStateTimeout.EventTimeTimeout)


def suppress(events: DataFrame, own: DataFrame, ttl: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Events without an own write (id, at) of the same key within `ttl` before them; works on streams and on tables."""
    seen = events.withWatermark("at", late).alias("e")
    writes = own.select(F.col("id").alias("own_id"), F.col("at").alias("own_at")).withWatermark("own_at", late)
    same = (F.col("id") == F.col("own_id")) & (F.col("own_at") <= F.col("at")) & (F.col("at") <= F.col("own_at") + F.expr(f"interval {ttl}"))
    return seen.join(writes, same, "left_outer").filter("own_id is null").drop("own_id", "own_at")


def renames(deleted: DataFrame, created: DataFrame, within: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """(old_id, new_id, at) where a note of the same non-empty set of chunk hashes is created within that time after a deletion.

    Inputs are (id, at, hashes array<string>); sets are compared as sorted arrays, so the join is one equality and a time bound.
    """
    key = lambda c: F.array_sort(F.array_distinct(c))
    old = deleted.filter(F.size("hashes") > 0).select(F.col("id").alias("old_id"), F.col("at").alias("gone_at"), key("hashes").alias("old_set")).withWatermark("gone_at", late)
    new = created.filter(F.size("hashes") > 0).select(F.col("id").alias("new_id"), "at", key("hashes").alias("new_set")).withWatermark("at", late)
    near = (F.col("at") >= F.col("gone_at")) & (F.col("at") <= F.col("gone_at") + F.expr(f"interval {within}"))
    return old.join(new, (F.col("old_set") == F.col("new_set")) & near).filter("old_id <> new_id").select("old_id", "new_id", "at")


def publisher(path: str):
    """For foreachBatch: each batch has a folder of its own, which a repeated batch replaces; so a retry changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last published row of each key, deletions left out."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("batch", "at")).alias("row"))
    return last.select(key, "row.*").filter("kind <> 'delete'")
