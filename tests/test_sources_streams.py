import datetime as dt

import pytest

from lodestack.operators import fulltext
from lodestack.sources import markdown
from lodestack.streaming import feeds
from pyspark.sql import functions as F

DOC = "---\ntitle: t\ntags: [a, b]\nsee: '[[Far]]'\n---\nIntro [[Near|x]]\n# One\nbody\n## Two\ndeep\n# Three\nend\n"


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".trash").mkdir()
    (tmp_path / "a" / "n.md").write_text(DOC)
    (tmp_path / "a" / "n.txt").write_text("no")
    (tmp_path / "e.md").write_text("\n")
    (tmp_path / "none.md").write_text("")
    (tmp_path / ".trash" / "x.md").write_text("gone")
    rows = {r["path"]: r for r in markdown.parse(markdown.scan(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a/n.md", "e.md"}
    note = rows["a/n.md"]
    assert note["title"] == "One" and rows["e.md"]["title"] == "e" and rows["e.md"]["sections"] == []
    assert note["properties"] == '{"see":"[[Far]]","tags":["a","b"],"title":"t"}'
    assert [x["target"] for x in note["links"]] == ["Near", "Far"]
    assert [(s["level"], s["path"]) for s in note["sections"]] == [(0, []), (1, ["One"]), (2, ["One", "Two"]), (1, ["Three"])]
    body = note["body"]
    assert body[note["sections"][1]["start"] : note["sections"][1]["end"]] == "# One\nbody\n## Two\ndeep\n"


def test_resolve_prefers_short_paths(spark):
    notes = spark.createDataFrame([(1, "x/y/n.md"), (2, "x/n.md"), (3, "m.md")], "id int, path string")
    links = spark.createDataFrame([("n",), ("x/y/n",), ("M.md",), ("m.md",), (" Em ",), (None,)], "target string")
    got = {r["target"]: r["resolved"] for r in markdown.resolve(links, notes, spark.createDataFrame([(3, "em"), (2, "M.md")], "id int, alias string")).collect()}
    assert got == {"n": 2, "x/y/n": 1, "M.md": 2, "m.md": 3, " Em ": 3, None: None}


@pytest.mark.parametrize(
    ("query", "want"),
    [("red fox", [1, 2]), ("red-fox", [1]), ("red NOT fox", [3]), ("fox OR cat", [1, 2, 4]), ("(red OR cat) NOT (fox AND slow)", [1, 3, 4]), ("re*", [1, 2, 3]), ("NEAR(red fox, 1)", [1, 2]), ("NEAR(red fox, 0)", [1]), ("AND red OR", [1, 2, 3]), ('"((red', [1, 2, 3]), ("", []), ("()", []), ("NOT", [])],
)
def test_fulltext(spark, query, want):
    docs = spark.createDataFrame([(1, "A red fox"), (2, "red, slow fox"), (3, "RED"), (4, "cat"), (5, None), (6, "")], "id int, text string")
    assert sorted(r["id"] for r in fulltext.matching(docs, query, "id", "text").collect()) == want
    assert sorted(r["id"] for r in fulltext.search(docs, query, "id", "text").collect()) == want


def test_snippet(spark):
    row = spark.createDataFrame([("one two Fox! four " * 3,)], "t string").select(fulltext.snippet(F.col("t"), ["fox"], 3, 1).alias("s")).first()
    assert row["s"] == "two <mark>Fox!</mark> four"


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def test_debounce_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    events = [("create", "a.md", 0), ("update", "a.md", 300), ("update", "a.md", 5000), ("delete", "a.md", 5100), ("update", "b.txt", 0)]
    events += [("update", "c.md", 400 * k) for k in range(14)]  # never quiet, so cut after five seconds
    first = spark.createDataFrame([(k, i, at(t)) for k, i, t in events], feeds.EVENT)
    first.coalesce(1).write.parquet(folder)
    spark.createDataFrame([("update", "z.md", at(600_000))], feeds.EVENT).coalesce(1).write.mode("append").parquet(folder)
    out = feeds.debounce(feeds.changes(spark, folder, files_per_trigger=1))
    stream = out.writeStream.foreachBatch(feeds.publisher(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert stream.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("id", "at").collect()
    got = [(r["id"], r["kind"], r["n"]) for r in rows if r["id"] != "z.md"]
    assert got == [("a.md", "update", 2), ("a.md", "delete", 2), ("c.md", "update", 13), ("c.md", "update", 1)]
    assert [r["id"] for r in feeds.current(spark, str(tmp_path / "out"), "id").orderBy("id").collect()] == ["c.md"]


def test_suppress_and_renames(spark):
    events = spark.createDataFrame([("update", "a.md", at(1000)), ("update", "a.md", at(9000)), ("update", "b.md", at(0))], feeds.EVENT)
    own = spark.createDataFrame([("a.md", at(0))], "id string, at timestamp")
    assert sorted((r["id"], r["at"]) for r in feeds.suppress(events, own).collect()) == [("a.md", at(9000)), ("b.md", at(0))]
    kind = "id string, at timestamp, hashes array<string>"
    gone = spark.createDataFrame([("old.md", at(0), ["x", "y"]), ("e.md", at(0), [])], kind)
    made = spark.createDataFrame([("new.md", at(3000), ["y", "x", "x"]), ("late.md", at(6000), ["x", "y"]), ("f.md", at(1), [])], kind)
    assert [(r["old_id"], r["new_id"]) for r in feeds.renames(gone, made).collect()] == [("old.md", "new.md")]
