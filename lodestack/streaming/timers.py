"""Changes in the order of their own time, with timers: renames, late deletions and own writes, whatever order they arrive in.

Events of a key wait in state until the watermark has passed them, and a timer hands them on sorted; so what comes out depends on
the events alone, not on batches. A rule keeps the few entries that are still open (a deletion that may turn out a rename, an own write
that may explain an event), each with the moment when it ends; a timer of its own closes it then. State holds what waits and what
is open, and nothing of a key once all of that is done. State needs Spark's RocksDB store.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestack.streaming.upkeep import GRACE_MS, PER_TICK, TTL_MS

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: at (milliseconds), kind, id, hash: an event as it waits; the same for an open entry.
ENTRY = "at long, kind string, id string, hash string"
OUT = "kind string, id string, old_id string, at timestamp"

Entry = tuple[int, str, str, str]
#: kind, id, old_id, at in milliseconds
Told = tuple[str, str, Any, int]


class Rule(ABC):
    """What becomes of a key's events. `span` is how long an entry stays open."""

    #: the order of kinds at one moment
    first: tuple[str, ...] = ()

    def __init__(self, span: int):
        self.span = span

    @abstractmethod
    def event(self, entry: Entry, open_: list[Entry]) -> Iterable[Told]:
        """What an event gives at once; `open_` may be changed. All open entries that ended before it are closed already."""

    @abstractmethod
    def ended(self, entry: Entry) -> Iterable[Told]:
        """What an entry gives that was open for its whole span."""


class Renames(Rule):
    """A deletion and a creation of one set of hashes (the key) within the span are a rename, the oldest open deletion of another note
    first; a deletion that nothing explains comes out when the span is over."""

    first = ("delete",)

    def __init__(self, span: int = GRACE_MS):
        super().__init__(span)

    def event(self, entry: Entry, open_: list[Entry]) -> Iterable[Told]:
        at, kind, name, _ = entry
        if kind == "delete":
            open_.append(entry)
            return []
        meant = next((e for e in open_ if e[2] != name), None) if kind == "create" else None
        if meant is None:
            return [(kind, name, None, at)]
        open_.remove(meant)
        return [("rename", name, meant[2], at)]

    def ended(self, entry: Entry) -> Iterable[Told]:
        return [("delete", entry[2], None, entry[0])]


class OwnWrites(Rule):
    """An own write (kind own) explains the first event of its note (the key) within the span, of the same hash where both have one."""

    first = ("own",)

    def __init__(self, span: int = TTL_MS):
        super().__init__(span)

    def event(self, entry: Entry, open_: list[Entry]) -> Iterable[Told]:
        at, kind, name, digest = entry
        if kind == "own":
            open_.append(entry)
            return []
        meant = next((e for e in open_ if not e[3] or not digest or e[3] == digest), None)
        if meant is None:
            return [(kind, name, None, at)]
        open_.remove(meant)
        return []

    def ended(self, entry: Entry) -> Iterable[Told]:
        return []


class InOrder(StatefulProcessor):
    def __init__(self, rule: Rule, most: int = PER_TICK):
        self.rule, self.most = rule, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.open = handle.getListState("waiting", ENTRY), handle.getListState("open", ENTRY)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            times = frame["at"].astype("datetime64[ms]").astype("int64").tolist()
            fresh = [(t, k, i, h if isinstance(h, str) else "") for t, k, i, h in zip(times, frame["kind"], frame["id"], frame["hash"], strict=True)]
            self.waiting.appendList(fresh)
            self.handle.registerTimer(max(min(times), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # All that lies before the watermark has come, so one timer does for all of it.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting, open_ = _entries(self.waiting), _entries(self.open)
        ready = sorted((e for e in waiting if e[0] <= now), key=lambda e: (e[0], e[1] not in self.rule.first, e[1], e[2], e[3]))
        left, told = self.most, []

        def close(until: int) -> bool:
            """Close what ended before, the oldest first; False if there is more than one tick may tell."""
            nonlocal left
            for e in sorted(open_):
                if e[0] + self.rule.span < until:
                    if not left:
                        return False
                    left -= 1
                    open_.remove(e)
                    told.extend(self.rule.ended(e))
            return True

        done, whole = 0, True
        for e in ready:
            if not close(e[0]):
                whole = False
                break
            told += self.rule.event(e, open_)
            done += 1
        whole = whole and close(now)
        rest = ready[done:] + [e for e in waiting if e[0] > now]
        if rest or open_:  # what one tick left goes with the next
            self.handle.registerTimer(min([e[0] for e in rest] + [e[0] + self.rule.span + 1 for e in open_]) if whole else now + 1)
        _put(self.waiting, rest)
        _put(self.open, open_)
        if told:
            frame = pd.DataFrame(told, columns=["kind", "id", "old_id", "at"])
            frame["at"] = pd.to_datetime(frame["at"], unit="ms")
            yield frame

    def close(self) -> None:
        pass


def _entries(state: Any) -> list[Entry]:
    return [tuple(x) for x in state.get()] if state.exists() else []


def _put(state: Any, entries: list[Entry]) -> None:
    if entries:
        state.put(entries)
    else:
        state.clear()


def in_order(events: DataFrame, by: str, rule: Rule, late: str = "10 seconds", most: int = PER_TICK) -> DataFrame:
    """kind, id, old_id, at: what the rule tells of events (`by`, kind, id, at, hash). Events that come later than `late` are lost.

    `most` bounds what is closed of one key in one tick; the rest goes with the next.
    """
    rows = events.withWatermark("at", late).select(by, "kind", "id", "at", "hash")
    return rows.groupBy(by).transformWithStateInPandas(InOrder(rule, most), OUT, "Append", "EventTime")


def renamed(events: DataFrame, span: int = GRACE_MS, late: str = "10 seconds", most: int = PER_TICK) -> DataFrame:
    """Events (kind, id, at, hashes array<string>) with renames told as such, and deletions only when nothing explained them in time.
    A note without hashes is never a rename."""
    digest = F.sha2(F.array_join(F.array_sort(F.array_distinct("hashes")), ","), 256)
    key = F.when(F.coalesce(F.size("hashes"), F.lit(0)) > 0, digest).otherwise(F.concat(F.lit("note:"), "id"))
    return in_order(events.select("kind", "id", "at", key.alias("set"), F.lit("").alias("hash")), "set", Renames(span), late, most)


def unexplained(events: DataFrame, own: DataFrame, span: int = TTL_MS, late: str = "10 seconds") -> DataFrame:
    """Events (kind, id, at, hash) without those that an own write (id, at, hash) explains."""
    both = events.select("id", "kind", "at", "hash").unionByName(own.select("id", F.lit("own").alias("kind"), "at", "hash"))
    return in_order(both.withColumn("note", F.col("id")), "note", OwnWrites(span), late)


def replay(spark: SparkSession, rows: DataFrame, folder: str, change: Any) -> DataFrame:
    """What a streaming query over the rows (with a column at) tells, once all of it has come and the clock has moved on.

    The rows are written below `folder` (a shared one) with a last one far ahead, which moves the watermark past all timers; `change` turns
    the stream into the query's result. Files, checkpoint and result stay in the folder.
    """
    source = f"{folder}/in"
    rows.write.parquet(source)
    kind = rows.schema["at"].dataType.simpleString()
    ahead = rows.agg(F.max("at").alias("last")).select(*[(F.expr("last + interval 10 years").cast(kind) if f.name == "at" else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    ahead.filter("at is not null").coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        stream = change(spark.readStream.schema(rows.schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
