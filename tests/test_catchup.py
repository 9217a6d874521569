from lodestack.operators import fulltext, postings
from lodestack.sources import markdown, vault
from lodestack.streaming import catchup


def test_a_folder_is_caught_up_with(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    for name, text in {"a.md": "red fox", "b.md": "red dog", "c.md": "", "d.md": "blue whale"}.items():
        (root / name).write_text(text)
    index = postings.build(spark.createDataFrame([], "path string, body string"), str(tmp_path / "i"), "path", "body")
    parsed = lambda: markdown.parse(vault.notes(spark, str(root)).select("path", "mtime", "text"))
    found = lambda q: sorted(r["key"] for r in fulltext.indexed(index, q).collect())
    assert catchup.catch_up(index, parsed()) == catchup.Caught(4, 0, 0, 0) and found("red") == ["a.md", "b.md"]
    version = index.view().version
    assert catchup.catch_up(index, parsed()) == catchup.Caught(0, 0, 0, 0) and index.view().version == version

    (root / "a.md").write_text("green fox")
    (root / "b.md").unlink()
    (root / "d.md").rename(root / "moved.md")
    (root / "new.md").write_text("red ant")
    assert catchup.catch_up(index, parsed()) == catchup.Caught(2, 1, 2, 1)
    assert found("red") == ["new.md"] and found("whale") == ["moved.md"] and found("gr*") == ["a.md"] and index.view().stats().first()["n"] == 4
    assert {(r["path"], r["change"], r["old_path"]) for r in catchup.compared(parsed(), catchup.known(index)).collect()} == set()
    while index.merge(fan=2):
        pass
    assert catchup.catch_up(index, parsed()) == catchup.Caught(0, 0, 0, 0) and found("red") == ["new.md"]  # merging keeps what is known
