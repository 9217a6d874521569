import datetime as dt
import random

from pyspark.sql import functions as F

from lodestack.streaming import timers

EVENT = "kind string, id string, at timestamp, hashes array<string>"


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def plainly(rows, span):
    """Renames and deletions of events (kind, id, ms, hashes) by going through them once in order."""
    out, open_ = [], {}
    for kind, name, ms, hashes in sorted(rows, key=lambda r: (r[2], r[0] != "delete", r[0], r[1])):
        waiting = open_.setdefault(tuple(sorted(set(hashes))) if hashes else ("note", name), [])
        if kind == "delete":
            waiting.append((ms, name))
            continue
        meant = next((w for w in sorted(waiting) if w[0] + span >= ms and w[1] != name and not w[2:]), None) if kind == "create" else None
        if meant:
            waiting.remove(meant)
            out.append(("rename", name, meant[1], ms))
        else:
            out.append((kind, name, None, ms))
    return sorted(out + [("delete", name, None, ms) for w in open_.values() for ms, name in w], key=str)


def told(df):
    return sorted(((r["kind"], r["id"], r["old_id"], round((r["at"] - at(0)).total_seconds() * 1000)) for r in df.collect()), key=str)


def test_renames_whatever_the_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["create", "create", "delete", "update"]), f"n{rng.randrange(9)}", rng.randrange(90_000), [rng.choice("abc")] if rng.random() < 0.9 else []) for _ in range(400)]
    frame = spark.createDataFrame([(k, i, at(t), h) for k, i, t, h in rows], EVENT)
    whole = told(timers.replay(spark, frame.coalesce(2), str(tmp_path / "r"), lambda s: timers.renamed(s, 3000)))
    assert whole == plainly(rows, 3000) and {"rename", "delete", "create", "update"} == {r[0] for r in whole}
    few = told(timers.replay(spark, frame.coalesce(1), str(tmp_path / "few"), lambda s: timers.renamed(s, 3000, most=1)))
    assert [r for r in few if r[0] == "rename"] and len([r for r in few if r[0] == "delete"]) <= len([r for r in rows if r[0] == "delete"])

    # The same in batches of files that overlap in time by less than the lateness, read again after a stop.
    folder = str(tmp_path / "in")
    for part in range(5):
        mine = [(k, i, at(t), h) for k, i, t, h in rows if (t + rng.randrange(5000)) // 19_000 == part]
        rows_left = [x for x in rows if (x[0], x[1], at(x[2]), x[3]) not in mine]
        spark.createDataFrame(mine, EVENT).coalesce(1).write.mode("append").parquet(folder)
        rows, kept = rows_left, rows
        stream(spark, folder, tmp_path)
    spark.createDataFrame([(k, i, at(t), h) for k, i, t, h in rows] + [(None, None, at(10**9), None)], EVENT).coalesce(1).write.mode("append").parquet(folder)
    stream(spark, folder, tmp_path)
    assert told(spark.read.parquet(str(tmp_path / "out"))) == whole


def stream(spark, folder, tmp_path):
    spark.conf.set(timers.STORE, timers.ROCKS)
    try:
        out = timers.renamed(spark.readStream.schema(EVENT).parquet(folder), 3000, late="100 seconds")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(timers.STORE)


def test_own_writes_explain_one_event_each(spark, tmp_path):
    kind = "kind string, id string, at timestamp, hash string"
    rows = [("own", "a", 0, "x"), ("update", "a", 500, "x"), ("update", "a", 900, "x"), ("own", "b", 0, None), ("update", "b", 2000, "q"), ("own", "c", 0, "x"), ("update", "c", 100, "y"), ("update", "c", 200, None), ("own", "d", 0, None), ("update", "d", 2001, None), ("update", "e", 5, None)]
    frame = spark.createDataFrame([(k, i, at(t), h) for k, i, t, h in rows], kind)
    split = lambda s: timers.unexplained(s.filter("kind <> 'own' or kind is null"), s.filter("kind = 'own'").drop("kind"))
    assert told(timers.replay(spark, frame, str(tmp_path / "o"), split)) == [("update", "a", None, 900), ("update", "c", None, 100), ("update", "d", None, 2001), ("update", "e", None, 5)]
    assert F is not None
