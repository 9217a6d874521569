"""What a change sets off: own writes that are passed over once, incremental indexing, staleness, late deletions, cursors, ownership."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestack.operators import assembly
from lodestack.operators.postings import FAN, Conflict, Index

#: How long an own write is expected, how long a deletion may turn out a rename, and the deletions of one tick.
TTL_MS, GRACE_MS, PER_TICK = 2000, 5000, 1024


def suppress_once(events: DataFrame, own: DataFrame, ttl_ms: int = TTL_MS, late: str = "10 seconds") -> DataFrame:
    """Events (id, kind, at, hash) without those that an own write (id, at, hash) explains: the first of its key within `ttl_ms`, of the
    same hash where both have one. A write explains one event only. State is a key's open writes, and goes with the watermark."""
    writes = own.select("id", F.lit("own").alias("kind"), "at", "hash")
    both = events.select("id", "kind", "at", "hash").unionByName(writes).withWatermark("at", late)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        waiting = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        rows = pd.concat(list(frames))
        rows = rows.assign(turn=(rows["kind"] != "own").astype(int)).sort_values(["at", "turn", "kind"])
        for kind, at, digest in zip(rows["kind"], rows["at"].astype("datetime64[ms]").astype("int64"), rows["hash"], strict=True):
            waiting = [w for w in waiting if at - w[0] <= ttl_ms]
            digest = digest if isinstance(digest, str) else ""
            if kind == "own":
                waiting.append((int(at), digest))
                continue
            meant = next((i for i, w in enumerate(waiting) if not w[1] or not digest or w[1] == digest), None)
            if meant is None:
                out.append((key[0], kind, at, digest or None))
            else:
                waiting.pop(meant)
        state.update(([w[0] for w in waiting], [w[1] for w in waiting]))
        # A timeout must lie beyond the watermark, whatever late rows came in.
        state.setTimeoutTimestamp(max(int(rows["at"].astype("datetime64[ms]").astype("int64").max()) + ttl_ms, state.getCurrentWatermarkMs()) + 1)
        frame = pd.DataFrame(out, columns=["id", "kind", "at", "hash"])
        frame["at"] = pd.to_datetime(frame["at"], unit="ms")
        yield frame

    return both.groupBy("id").applyInPandasWithState(run, "id string, kind string, at timestamp, hash string", "at array<bigint>, hash array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def last_kinds(batch: DataFrame) -> DataFrame:
    """id, kind: the last event of each key in a batch."""
    return batch.groupBy("id").agg(F.max_by("kind", F.struct("at", "kind")).alias("kind"))


def reindexer(index: Index, read: Callable[[DataFrame], DataFrame], text: str = "text", vault: str | None = None, *, source: str | None = None, fan: int = FAN, tries: int = 5) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the documents of a batch's changed keys, as `read` (id -> id, text) finds them, replace their rows in the index;
    deleted keys, and those that aren't found, go.

    With `source`, the stream's own name, the index's manifest keeps the last batch with the change itself, so that a batch that is
    repeated after a crash is taken once; without, a repeated batch adds a segment that changes nothing. Where another writer comes between,
    the batch is made again from the newest version. Segments are merged as they become many.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        last = last_kinds(batch).persist()
        docs = read(last.filter("kind <> 'delete'").select("id"))
        removed = last.select(F.col("id").alias("key")).join(docs.select(F.col("id").alias("key")), "key", "left_anti")
        _again(lambda: index.replace(docs, removed, "id", text, vault, source=source, batch=batch_id if source is not None else None), tries)
        last.unpersist()
        _again(lambda: index.merge(fan), tries)

    return run


def _again(change: Callable[[], bool], tries: int) -> bool:
    """Make a change, anew where another writer was first."""
    for left in range(tries - 1, -1, -1):
        try:
            return change()
        except Conflict:
            if not left:
                raise
    return False


def touched(batch: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """brief, changed (sorted ids): the briefs that a batch's events concern and whose sources (brief, id, hash) differ from now (id, hash)."""
    mine = recorded.join(batch.select("id").distinct(), "id", "left_semi").select("brief").distinct()
    stale = assembly.stale_sources(recorded.join(mine, "brief", "left_semi"), current, "id")
    return stale.groupBy("brief").agg(F.array_sort(F.collect_set("id")).alias("changed"))


def mark_stale(briefs: DataFrame, stale: DataFrame) -> DataFrame:
    """briefs (brief, status, ...) whose sources changed as stale; superseded ones stay as they are."""
    hit = stale.select("brief", F.lit(True).alias("hit")).distinct()
    out = briefs.join(hit, "brief", "left")
    return out.withColumn("status", F.when(F.col("hit") & (F.coalesce("status", F.lit("")) != "superseded"), "stale").otherwise(F.col("status"))).drop("hit")


def due(deleted: DataFrame, renamed: DataFrame, now: Column, grace_ms: int = GRACE_MS, most: int = PER_TICK) -> DataFrame:
    """The oldest deletions (id, at) of this tick that no rename (old_id) explained in time; the others wait for the next one."""
    ready = deleted.filter(F.col("at") <= now - F.expr(f"interval {grace_ms} milliseconds"))
    return ready.join(renamed.select(F.col("old_id").alias("id")), "id", "left_anti").orderBy("at", "id").limit(most)


class Cursor:
    """The last moment that a reader has seen, in a written table; a reader that crashed goes on from there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self):
        try:
            return self.spark.read.parquet(self.path).agg(F.max("at")).first()[0]
        except Exception as error:  # noqa: BLE001  only a missing table is no cursor
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def after(self, events: DataFrame) -> DataFrame:
        at = self.get()
        return events if at is None else events.filter(F.col("at") > F.lit(at))

    def advance(self, events: DataFrame) -> None:
        events.agg(F.max("at").alias("at")).filter("at is not null").write.mode("append").parquet(self.path)


class Owner:
    """One owner of a folder at a time: a file that only one process can create."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.file = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.owns = False

    def __enter__(self) -> Owner:
        try:
            self.fs.create(self.file, False).close()
        except Exception as error:
            raise RuntimeError(f"{self.file} has an owner") from error
        self.owns = True
        return self

    def __exit__(self, *_) -> None:
        if self.owns:
            self.fs.delete(self.file, False)
            self.owns = False
