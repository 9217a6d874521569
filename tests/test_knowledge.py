import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text
from lodestack.operators import edges, frontmatter, links, memory, outline, postings, predicates, profiles, records
from lodestack.plans import workflow
from lodestack.sources import stores
from lodestack.streaming import feeds, upkeep


def slow_spans(body, most):
    """Chunk spans by another road: marks of where each kind of cut may be, taken greedily from the left."""
    heads = [at for at, level, _ in text.headings(body) if level <= 3]
    edges_ = sorted({0, len(body), *heads})
    out = []

    def pack(parts, finer):
        while parts:
            n = 1
            while n < len(parts) and parts[n][1] - parts[0][0] <= most:
                n += 1
            a, b = parts[0][0], parts[n - 1][1]
            parts = parts[n:]
            if b - a <= most:
                out.append((a, b))
            else:
                finer(a, b)

    def hard(a, b):
        out.extend((i, min(b, i + most)) for i in range(a, b, most))

    def sentences(a, b):
        ends = [a + m.end() for m in re.finditer(r"[.!?]\s+(?=[A-ZÄÖÜ])", body[a:b])]
        pack(list(zip([a, *ends], [*ends, b])), hard)

    def paragraphs(a, b):
        parts, at = [], a
        for m in re.finditer(r"\n\n+", body[a:b]):
            if a + m.start() > at:
                parts.append((at, a + m.start()))
            at = a + m.end()
        if at < b:
            parts.append((at, b))
        pack(parts or [(a, b)], sentences)

    for a, b in zip(edges_, edges_[1:]):
        if b - a <= most:
            out.append((a, b))
        else:
            paragraphs(a, b)
    return out


def test_chunks_equal_brute_force():
    rng = random.Random(3)
    pieces = ["word ", "Big ", "end. ", "Now! ", "\n\n", "\n# Head\n", "\n#### low\n", "x" * 70, "\n```\n# no\n```\n", "Ärger. Über "]
    for _ in range(300):
        body = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))
        got = text.chunks(body, 15, 0)
        if len(body) > 60:
            assert [(a, b) for a, b, _ in got] == [(a, b) for a, b in slow_spans(body, 60) if len(body[a:b].strip()) >= 3]
        for first, (a, b, _) in zip(slow_spans(body, 60), text.chunks(body, 15, 4)):
            assert b - a <= 60 + 16
    body = "One here. Two there. " * 4 + "three goes on and on without an end " * 3
    parts = text.chunks(body, 20, 10)
    assert parts[0][:2] == (0, 63) and parts[1][0] == 42 and body[42:].startswith("Two") is False or parts[1][0] < parts[0][1]
    assert text.chunks("", 20) == [] == text.chunks(" a", 20) and text.chunks("## T\nbody", 20)[0][2] == "## T"


def test_headings_items_statements_relations():
    assert [text.heading_of(x) for x in ("# A", "####### no", "#no", "   ## B ##", "    # no", "#", "## C#", "## D # ")] == [(1, "A"), None, None, (2, "B"), None, (1, ""), (2, "C#"), (2, "D")]
    body = "- one\n  more\n\n  apart\n* [x] done\n- [fact] a `- [no]`\n- [Fact] no\n```\n- [code] no\n```\n- [idea] b <!-- validity: {\"valid_from\":\"2024-01-01T00:00:00Z\"} -->\n- [bad] c <!-- validity: {\"valid_to\":3} -->\n- [odd] d <!-- validity: nope -->"
    assert [i[2] for i in text.list_items(body)][:2] == ["one\nmore", "[x] done"]
    got = text.statements(body)
    assert [s[2:4] for s in got] == [("fact", "a `- [no]`"), ("idea", "b"), ("bad", "c"), ("odd", "d")]
    assert got[1][4] == 1704067200000 and got[2][6] == "valid_to" and got[3][6] == "annotation"
    rel = "## Relations\n- uses [[X|x]]\n- Uses [[X]]\n- uses [[X]] tail\n### Relations\n- part_of [[Y]]\n## Else\n- uses [[Z]]"
    assert [r[:2] for r in text.relations(rel)] == [("uses", "X"), ("part_of", "Y")] and text.relations("## relations\n- uses [[X]]") == []
    assert text.validity({"valid_from": "2024-01-02T00:00:00Z", "valid_to": "2024-01-01T00:00:00Z"})[2] == "valid_to" and text.instant("2024-02-30T00:00:00Z") is None
    assert text.slug("Ünïcode — Claim!" + " long" * 30).startswith("unicode-claim-long") and len(text.slug("a " * 90)) <= 60 and text.slug("…") == "observation"
    assert text.without_views("a\n~~~ DataviewJS\nx\n~~~~\nb\n```datacore\nopen") == ("a\n[Datacore view]\nb\n[Datacore view]", 2) and text.without_views("```sql\nx\n```") == ("```sql\nx\n```", 0)
    assert text.aliases(["a", 3, None, "b"]) == ["a", "b"] and text.aliases("x") == ["x"] and text.aliases(4) == []


def test_edits():
    props = {"a": 1, "l": ["x", {"k": [1]}], "o": {"p": 1, "q": 2}, "t": True}
    now, diff = frontmatter.edit(props, {"a": 1, "l": {"$pull": {"k": [1]}}, "o": {"q": 3}, "t": 1, "s": {"$push": 5}, "a2": {"$unset": 1}, "z": None})
    assert now == {"a": 1, "l": ["x"], "o": {"p": 1, "q": 3}, "t": 1, "s": [5], "z": None}
    assert [d[:2] for d in diff] == [("l", "pull"), ("o", "set"), ("t", "set"), ("s", "push"), ("z", "set")]
    assert frontmatter.edit({"a": 1}, {"a": {"$push": 2}, "b": {"$pull": 1}})[0] == {"a": [2]} and frontmatter.edit({"a": 1}, {"a": {"$unset": 1}}) == ({}, [("a", "unset", 1, frontmatter._GONE)])
    body = "# A\nx\n## B\ny\n### C\nz\n## D\nw"
    assert frontmatter.patch_section(body, ["A", "B"], "new") == ("# A\nx\n## B\nnew\n## D\nw", None)
    assert frontmatter.patch_section(body, ["A", "D"], "") == ("# A\nx\n## B\ny\n### C\nz\n## D\n", None)
    assert frontmatter.patch_section("# A", ["A"], "t") == ("# A\nt", None) and frontmatter.patch_section(body, ["B"], "t")[1] == "target_not_found"
    assert frontmatter.patch_section("# A\n# A", ["A"], "t")[1] == "ambiguous_target" and frontmatter.patch_section(body, [], "t")[1] == "invalid_patch"
    assert frontmatter.patch_section("# A\r\nx\r\n# B", ["A"], "1\n2")[0] == "# A\r\n1\r\n2\r\n# B"


def test_typed_properties(spark):
    rows = [(1, '{"a":7,"c":true,"d":[1,"x",null],"f":{"g":[5]}}'), (2, '{"a":"7","c":"true","d":"x"}'), (3, None), (4, "not json"), (5, '{"a":null}')]
    df = spark.createDataFrame(rows, "id long, p string")
    ids = lambda c: [r["id"] for r in df.filter(c).orderBy("id").collect()]
    assert [ids(predicates.match_props("p", w)) for w in ({"a": 7}, {"a": "7"}, {"c": True}, {"d": {"$contains": 1}}, {"d": {"$contains": "x"}}, {"f.g.0": 5}, {"a": {"$in": []}}, {"a": {"$in": [7, "7"]}})] == [[1], [2], [1], [1], [1], [1], [], [1, 2]]
    assert ids(predicates.matches_text("p", "a", "7")) == [1, 2] == ids(predicates.matches_text("p", "d", "x")) and ids(predicates.strictly("p", {"a": None})) == [5]
    every = df.withColumn("mtime", F.col("id"))
    assert predicates.query_props(every, "p", {}, "mtime", "id").count() == 5 and predicates.query_props(every, "p", {}, "mtime", "id", 0).count() == 1


def test_edges_and_clusters(spark):
    kind = "src long, dst long, target string, type string, rel string, line int"
    rows = spark.createDataFrame([(1, 2, None, "wikilink", None, 1), (1, 2, None, "wikilink", None, 1), (1, 2, None, "wikilink", None, 2), (1, 3, None, "frontmatter-ref", "owner", None)], kind)
    every = edges.union(rows, rows)
    assert every.count() == 3 and edges.chosen(every, roles=[]).count() == 0 and edges.chosen(every, roles=["owner"]).count() == 1 and edges.chosen(every).count() == 3
    was = spark.createDataFrame([(1, "h")], "id long, hash string")
    assert [r["stale"] for r in edges.fresh(every, was, was.limit(0)).orderBy("type", "line").collect()] == [True, False, False]
    cliques = [(a, b, None, "t", None, 1) for base in (0, 10) for a in range(base, base + 5) for b in range(base, a)] + [(4, 10, None, "t", None, 1), (99, 98, None, "t", None, 1)]
    graph = spark.createDataFrame(cliques, kind)
    seeds = spark.createDataFrame([(0,), (10,), (50,)], "seed long")
    got = [(r["node"], r["cluster"]) for r in edges.cluster(graph, seeds).collect()]
    assert got == [(i, 0) for i in range(5)] + [(i, 10) for i in range(10, 15)] + [(50, 50)]
    with pytest.raises(ValueError, match="force"):
        edges.cluster(graph, seeds, limit=3)


def test_outline_tree_nests(spark):
    rows = spark.createDataFrame([(1, 1, None, 0, 0, 9), (1, 2, 1, 5, 1, 2), (1, 3, 1, 3, 3, 4), (1, 4, 9, 7, None, None)], "note long, id long, parent long, pos int, low int, high int")
    chunks = spark.createDataFrame([(1, c) for c in range(5)], "note long, chunk int")
    tree = outline.tree(outline.outline(rows, chunks).collect())
    assert [n["id"] for n in tree] == [1, 4] and [n["id"] for n in tree[0]["children"]] == [3, 2] and tree[0]["children"][0]["chunks"] == [3, 4] and tree[1]["chunks"] == []


def test_records(spark):
    msg = "provider string, external_id string, id string, role string, text string, at string"
    rows = [("p", "1", "a", "user", "x", None), ("p", "1", "a", "user", "y", None), ("p", "2", "a", "user", "x", "2024-01-01"), ("p\n", "3", "a", "user", "x", None), ("p", "4", "a", "tool", "", "2024-01-01T00:00:00Z"), (None, "5", "a", "user", "x", None)]
    assert {r["external_id"]: r["error"] for r in records.checked_messages(spark.createDataFrame(rows, msg)).collect()} == {"1": "duplicate_message", "2": "time", "3": "identity", "4": None, "5": "identity"}
    many = spark.range(60).select(F.lit(1).alias("brief"), "id").unionByName(spark.range(2).select(F.lit(2).alias("brief"), "id"))
    notes = spark.range(60).select("id", F.lit("v").alias("vault"), F.col("id").cast("string").alias("hash"))
    got = {r["brief"]: (r["error"], r["hashes"]) for r in records.compile_briefs(many, notes).collect()}
    assert got == {1: ("too_many_sources", None), 2: (None, {0: "0", 1: "1"})}
    log = spark.range(2000).select("id", F.lit("n").alias("note"), F.lit("op").alias("op"), F.lit(dt.datetime(2024, 1, 1)).alias("at"), F.lit(None).cast("boolean").alias("sink"))
    assert records.audit(log, limit=9999).count() == 1000 and records.audit(log).count() == 50 and records.audit(log, in_sink=True).count() == 0 and records.audit(log, limit=0).first()["id"] == 1999


def test_profiles(spark):
    notes = spark.createDataFrame([(1, '{"a":1,"b":[1]}'), (2, '{"a":"x"}'), (3, "[]"), (4, None)], "id long, p string")
    assert {r["field"]: (r["types"], r["present"], r["total"]) for r in profiles.fields(notes, "id", "p").collect()} == {"a": (["number", "string"], 2, 4), "b": (["array"], 1, 4)}
    strict = profiles.inspect(notes.filter("id = 1"), "id", "p", [("a", ["string"], True), ("c", [], True)], strict=True)
    assert sorted((r["field"], r["code"], r["level"]) for r in strict.collect()) == [("a", "invalid_type", "error"), ("b", "unexpected_field", "error"), ("c", "missing_required", "error")]
    links_ = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (1, 1), (1, None)], "src long, dst long")
    assert sorted(map(tuple, profiles.neighbours(links_).filter("note = 1").collect())) == [(1, 2), (1, 3)]


def test_hyperlinks_outside_code(spark):
    body = "# https://head.org\nsee https://a.org/x. (https://b.org) [t](https://c.org/a) `https://d.org`\n```\nhttps://e.org\n```\n![i](https://f.org)"
    rows = spark.createDataFrame([(1, body), (2, None)], "id long, text string").select("id", links.prose("text").alias("text"))
    assert sorted((r["line"], r["url"]) for r in links.hyperlinks(rows, "id", "text").collect()) == [(2, "https://a.org/x"), (2, "https://c.org/a"), (6, "https://f.org")]


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def test_own_writes_explain_one_event(spark, tmp_path):
    kind = "id string, kind string, at timestamp, hash string"
    spark.createDataFrame([("a", "update", at(500), "h"), ("a", "update", at(900), "h"), ("a", "update", at(9000), "h"), ("b", "update", at(100), "x"), ("z", "update", at(900_000), None)], kind).coalesce(1).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([("a", "", at(0), None), ("a", "", at(6000), "h"), ("b", "", at(0), "y")], kind).coalesce(1).write.parquet(str(tmp_path / "o"))
    read = lambda name: spark.readStream.schema(kind).parquet(str(tmp_path / name))
    out = upkeep.suppress_once(read("e"), read("o"))
    stream = out.writeStream.foreachBatch(feeds.publisher(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert stream.awaitTermination(120)
    assert sorted((r["id"], r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", at(900)), ("a", at(9000)), ("b", at(100)), ("z", at(900_000))]


def test_incremental_index_and_staleness(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "red fox"), ("b.md", "blue")], "id string, text string")
    index = postings.build(docs, str(tmp_path / "i"), "id", "text")
    now = spark.createDataFrame([("a.md", "green"), ("c.md", "red")], "id string, text string")
    batch = spark.createDataFrame([("update", "a.md", at(0)), ("create", "c.md", at(1)), ("update", "b.md", at(1)), ("delete", "b.md", at(2))], feeds.EVENT)
    run = upkeep.reindexer(index, lambda ids: now.join(ids, "id", "left_semi"))
    for n in range(2):  # a repeated batch changes nothing
        run(batch, n)
        assert [r["key"] for r in index.bm25(["red"], 5).collect()] == ["c.md"] and index.bm25(["blue", "fox"], 5).count() == 0
    recorded = spark.createDataFrame([(1, "a.md", "old"), (1, "c.md", "h"), (2, "c.md", "h"), (3, "x.md", "h")], "brief int, id string, hash string")
    current = spark.createDataFrame([("a.md", "new"), ("c.md", "h")], "id string, hash string")
    stale = upkeep.touched(batch, recorded, current)
    assert [tuple(r) for r in stale.collect()] == [(1, ["a.md"])]
    briefs = spark.createDataFrame([(1, None), (2, "ok")], "brief int, status string")
    assert sorted(tuple(r) for r in upkeep.mark_stale(briefs, stale).collect()) == [(1, "stale"), (2, "ok")]
    gone = spark.createDataFrame([("a", at(0)), ("b", at(1)), ("c", at(9000))], "id string, at timestamp")
    assert [r["id"] for r in upkeep.due(gone, spark.createDataFrame([("a",)], "old_id string"), F.lit(at(6000))).collect()] == ["b"]


def test_cursor_and_owner(spark, tmp_path):
    cursor = upkeep.Cursor(spark, str(tmp_path / "c"))
    events = spark.createDataFrame([("a", at(0)), ("b", at(5))], "id string, at timestamp")
    assert cursor.after(events).count() == 2
    cursor.advance(events.limit(0))
    cursor.advance(events.filter("id = 'a'"))
    assert [r["id"] for r in upkeep.Cursor(spark, str(tmp_path / "c")).after(events).collect()] == ["b"]
    lock = str(tmp_path / "lock")
    with upkeep.Owner(spark, lock):
        with pytest.raises(RuntimeError, match="owner"), upkeep.Owner(spark, lock):
            pass
    with upkeep.Owner(spark, lock):
        pass


def test_stores(spark, tmp_path):
    notes = spark.range(10).select("id", F.concat(F.lit("a_b/"), "id", F.lit(".md")).alias("path"), F.lit(at(0)).alias("mtime"))
    assert [r["id"] for r in stores.page(notes, 6, 2).collect()] == [7, 8] and stores.exists(notes, "a_b/3.md") and not stores.exists(notes, "a")
    assert stores.below(notes, "a%b").count() == 0 and stores.below(notes, "a_b/").count() == 10 and stores.documents(notes, exclude=["a_b/1.md"], limit=3).count() == 3 and stores.documents(notes, since=F.lit(at(0))).count() == 0
    calls = []

    def provider(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("once")
        return [[len(t), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(25)], "id int, t string").coalesce(1)
    got = {r["id"]: r["v"] for r in rows.select("id", stores.embedded("t", provider, wait=0.0).alias("v")).collect()}
    assert got[3] is None and got[7] == [7.0, 1.0] and len(got) == 25
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.yaml").write_text("name: row-count\ninputs: {n: {required: true}}\nassembly:\n  - {as: rows, verb: rows, args: {n: '{{n}}'}}\noutput_shape: [rows]\n")
    (tmp_path / "sub" / "c.yaml").write_text("x")
    (tmp_path / "a.txt").write_text("x")
    (name, body), = stores.workflow_files(spark, str(tmp_path))
    flow = workflow.parse(body)
    assert name == "b.yaml" and flow.run({"rows": lambda n: spark.range(n)}, {"n": 4})["rows"].count() == 4
    assert workflow.listing([flow]) == [{"name": "row-count", "steps": 1, "verbs": ["rows"]}] and workflow.written_back(flow, {"rows": 1}, "rows", lambda v: v + 1) == 2
    import time

    with pytest.raises(TimeoutError):
        workflow.peer(lambda: time.sleep(1), 0.05)()
    assert workflow.Workflow("a", (workflow.Step("x", "mcp://s/t"),)).problems({}) == ["peer 'mcp://s/t' isn't registered"]


def test_writes_keep_ids_and_follow_chains(spark, tmp_path):
    current = spark.createDataFrame([("a", "1", 7), ("b", "2", 8)], "path string, hash string, id long")
    writes = spark.createDataFrame([("a", "9", None, False), ("c", "3", None, False), ("b", None, "0", True)], "path string, hash string, expected string, delete boolean")
    rows = {r["path"]: (r["hash"], r["id"]) for r in memory.apply_writes(current, writes).collect()}
    assert rows["a"] == ("9", 7) and rows["b"] == ("2", 8) and rows["c"][0] == "3" and rows["c"][1] is not None
    bodies = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "path string, text string")
    verdicts = memory.write_notes(current, writes, bodies, str(tmp_path / "w"), F.expr("timestamp'2024-01-01'"), "me")
    assert {r["path"]: r["action"] for r in verdicts.collect()} == {"a": "updated", "b": "refused: hash_mismatch", "c": "created"}
    assert sorted(r["path"] for r in spark.read.parquet(str(tmp_path / "w" / "notes")).collect()) == ["a", "c"] and spark.read.parquet(str(tmp_path / "w" / "audit")).count() == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(300, None), (400, 401), (401, 400), (500, 999)], "id long, next long")
    got = {r["start"]: (r["final"], r["hops"]) for r in memory.follow(chain, 100).collect()}
    assert got[0] == (100, 100) and got[250] == (300, 50) and got[300] == (300, 0) and got[400] == (400, 100) and got[500] == (500, 0)
