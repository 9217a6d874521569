from lodestack.operators import briefs, memory
from pyspark.sql import functions as F

RECORD = "path string, agent boolean, source string, confidence string, status string, observed_at string, superseded_by string"


def test_validate(spark):
    rows = [
        ("_memory/ok.md", True, "agent", "direct", "active", "2024-01-01", None),
        ("_memory/a.md", True, "agent", "direct", None, None, None),
        ("_memory/b.md", True, " ", "direct", None, "2024-01-01", None),
        ("_memory/c.md", True, "agent", "sure", None, "2024-01-01", None),
        ("_memory/d.md", True, "agent", None, "superseded", "2024-01-01", None),
        ("_memory/e.md", True, "agent", None, "active", "2024-01-01", "x"),
        ("notes/f.md", True, "agent", None, None, None, None),
        ("_memory/g.md", None, "me", None, None, "2024-01-01", None),
        ("notes/h.md", False, None, None, None, None, None),
    ]
    got = {r["path"][-4]: (r["reason"], r["key"]) for r in memory.validate(spark.createDataFrame(rows, RECORD), ["_memory/"]).collect()}
    assert got == {
        "k": (None, None), "a": ("missing_provenance", "observed_at"), "b": ("missing_provenance", "source"), "c": ("invalid_provenance", "confidence"),
        "d": ("supersede_mismatch", "superseded_by"), "e": ("supersede_mismatch", "superseded_by"), "f": ("agent_write_outside_sink", "-"), "g": ("sink_is_for_agents", "-"), "h": (None, None),
    }


def test_writes(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    writes = spark.createDataFrame(
        [("a", "9", "1", False), ("b", "9", "0", False), ("c", None, "3", True), ("d", "4", None, None), ("e", None, "1", True), ("f", "1", "1", False)], "path string, hash string, expected string, delete boolean"
    )
    got = {r["path"]: r["action"] for r in memory.stage_writes(current, writes).collect()}
    assert got == {"a": "updated", "b": "refused: hash_mismatch", "c": "deleted", "d": "created", "e": "refused: not_found", "f": "refused: hash_mismatch"}
    assert sorted(map(tuple, memory.apply_writes(current, writes).collect())) == [("a", "9"), ("b", "2"), ("d", "4")]


def test_patches(spark):
    row = spark.createDataFrame([({"a": "1", "b": "2"}, "x.y x")], "m map<string,string>, t string")
    got = row.select(memory.patch_map("m", put={"a": "9", "c": "3"}, unset=["b"]).alias("m"), *[memory.replace_once(F.col("t"), o, "z").alias(n) for n, o in (("one", "."), ("two", "x"), ("none", "q"))]).first()
    assert got["m"] == {"a": "9", "c": "3"} and got["one"]["text"] == "xzy x" and got["one"]["error"] is None
    assert got["two"]["error"] == "ambiguous_target" and got["none"]["error"] == "target_not_found" and got["none"]["text"] == "x.y x"


def test_folders_and_suggestions(spark):
    notes = spark.createDataFrame([("a/b/1",), ("a/b/2",), ("a/3",), ("top",), ("q/1",)], "path string")
    assert sorted(map(tuple, memory.prior_folder(notes).collect())) == [("a/3", "a"), ("a/b/1", "a"), ("a/b/2", "a")]
    asked = spark.createDataFrame([("s", "x", 0.9, "folder"), ("s", "y", 0.9, "neighbor"), ("t", "x", 0.3, "neighbor"), ("u", "x", 0.5, "content"), ("v", "x", 0.5, "content")], "key string, value string, confidence double, origin string")
    own = spark.createDataFrame([("u", "x")], "key string, value string")
    got = {(r["key"], r["value"], r["verdict"]) for r in briefs.suggest(asked.withColumn("note", F.lit(1)), own.withColumn("note", F.lit(1))).collect()}
    assert got == {("s", "x", "conflict"), ("s", "y", "conflict"), ("u", "x", "existing"), ("v", "x", "suggestion")}


def test_recall(spark):
    rows = [("_memory/a", 1.0, None, "2024-01-02", 1, "fact", "direct"), ("_memory/a", 2.0, None, "2024-01-02", 1, "fact", "direct"), ("_memory/b", 9.0, "superseded", "2024-01-03", 1, "fact", "direct"), ("_memory/c", 1.0, "active", None, 5, "fact", "inferred"), ("x/d", 3.0, None, "2024-01-01", 1, "fact", "direct")]
    hits = spark.createDataFrame(rows, "path string, score double, status string, observed_at string, mtime long, type string, confidence string").withColumns({"valid_from": F.lit(None).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    now = F.expr("timestamp'2024-02-01'")
    assert [(r["path"], r["score"]) for r in memory.recall(hits, now, sinks=["_memory/"]).collect()] == [("_memory/a", 2.0), ("_memory/c", 1.0)]
    assert [r["path"] for r in memory.recall(hits, now, sinks=["_memory/"], confidence="direct", types=["fact"], days=60).collect()] == ["_memory/a"]
