import datetime as dt
import hashlib
import os
import time

from pyspark.sql import functions as F

from lodestack.sources import markdown, vault


def test_anchors_hash_a_section_s_own_text():
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    body = "before\n\n# One\nown\n\n## Two\n```\n# code\n```\n# Cafe\u0301\n"
    assert [(s["level"], s["anchor"]) for s in markdown.sections(body)] == [(0, sha("\nbefore\n")), (1, sha("One\nown\n")), (2, sha("Two\n```\n# code\n```")), (1, sha("Caf\u00e9\n"))]
    assert [s["anchor"] for s in markdown.sections("# A\nx\n## B\ny")] == [sha("A\nx"), sha("B\ny")] and [s["anchor"] for s in markdown.sections("# A")] == [sha("A\n")]


def write(root, path, text, at=None):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(text.encode())
    if at is not None:
        os.utime(file, (at, at))


def test_all_notes_are_read_and_filters_prune(spark, tmp_path):
    at = 1_700_000_000
    for path, text, t in (("a/n.md", "# One\r\nx", at), ("a/deep/er/m.md", "deep", at + 10), ("b/é.md", "naïve", at + 20), ("top.md", "top", at), ("b/none.md", "", at + 30), ("b/n.txt", "no", at), (".trash/x.md", "gone", at), ("a/.obsidian/y.md", "kept", at), ("c/skip/z.md", "z", at)):
        write(tmp_path, path, text, t)
    got = lambda df: sorted(r["path"] for r in df.collect())
    for depth in (1, 2):
        df = vault.notes(spark, str(tmp_path), depth=depth)
        rows = {r["path"]: r for r in df.collect()}
        assert set(rows) == {"a/n.md", "a/deep/er/m.md", "b/é.md", "top.md", "b/none.md", "a/.obsidian/y.md", "c/skip/z.md"}
        assert rows["b/none.md"]["text"] == "" and rows["b/none.md"]["bytes"] == 0 and rows["a/n.md"]["text"] == "# One\nx"
        assert df.select(F.unix_timestamp("mtime").alias("t"), "path").filter("path = 'b/é.md'").first()["t"] == at + 20
        assert got(df.filter(F.col("path").startswith("a/"))) == ["a/.obsidian/y.md", "a/deep/er/m.md", "a/n.md"]
        assert got(df.filter("path = 'top.md'")) == ["top.md"] and got(df.filter("path = 'absent.md'")) == []
        assert got(vault.notes(spark, str(tmp_path), since=dt.datetime.fromtimestamp(at + 10, dt.timezone.utc).isoformat())) == ["b/none.md", "b/é.md"]
        assert got(df.filter(F.col("mtime") >= F.timestamp_seconds(F.lit(at + 20)))) == ["b/none.md", "b/é.md"]
        assert got(vault.notes(spark, str(tmp_path), exclude="**/skip/**;b/*", depth=depth)) == [".trash/x.md", "a/.obsidian/y.md", "a/deep/er/m.md", "a/n.md", "top.md"]
    note = {r["path"]: r for r in markdown.parse(vault.notes(spark, f"file://{tmp_path}").select("path", "mtime", "text")).collect()}
    assert note["b/none.md"]["title"] == "none" and note["a/n.md"]["title"] == "One"  # an empty note is a note

    reader = vault.NoteReader({"path": str(tmp_path), "depth": "1"})
    assert [f.name for f in reader.partitions()] == ["", "a/", "b/", "c/"]
    assert list(reader.pushFilters([vault.StringStartsWith(("path",), "a/deep")])) and [f.name for f in reader.partitions()] == ["", "a/"]
    opened = vault.NoteReader({"path": str(tmp_path), "since": dt.datetime.fromtimestamp(at + 25, dt.timezone.utc).isoformat()})
    assert [list(opened.tree.files(f)) for f in opened.partitions()] == [[], [], [("b/none.md", (at + 30) * 1_000_000, 0)], []]


def test_a_restarted_stream_goes_on(spark, tmp_path):
    root, out = tmp_path / "notes", str(tmp_path / "out")
    root.mkdir()

    def run():
        stream = vault.changed_notes(spark, str(root), settle_ms=0).select("path", "text")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        query.awaitTermination()
        return sorted((r["path"], r["text"]) for r in spark.read.schema("path string, text string").parquet(out).collect())

    base = int(time.time()) - 100
    write(root, "a/one.md", "1", base)
    write(root, "two.md", "", base + 1)
    first = run()
    assert first == [("a/one.md", "1"), ("two.md", "")]
    assert run() == first
    write(root, "a/one.md", "1 again", base + 5)
    write(root, "b/three.md", "3", base + 6)
    assert run() == sorted([*first, ("a/one.md", "1 again"), ("b/three.md", "3")])
