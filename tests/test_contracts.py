"""Workflow files with typed inputs, and the verbs over a small collection."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestack.operators import postings
from lodestack.plans import verbs, workflow

DAY = dt.datetime(2024, 5, 1)
FLOW = """
version: 1
name: review-prep
description: What to know before a review.
inputs:
  vault: {type: string}
  doc: {$ref: "#/types/DocId", description: the note}
  hops: {type: integer, minimum: 1, maximum: 2, default: 1}
  sink: {$ref: "#/types/MemorySink"}
required: [vault, doc]
sinks: {default_sink: {handle: _memory/_briefs, required: true}}
assembly:
  - {as: note, verb: read_note, args: {doc_id: "{{inputs.doc}}"}}
  - {as: linked, verb: expand, args: {seed_doc_ids: ["{{inputs.doc}}"], hops: "{{inputs.hops}}", direction: both}}
  - {as: clustered, verb: cluster, args: {seed_doc_ids: "{{linked.doc_ids}}", method: edge-community}}
  - {as: compiled, verb: compile_brief, args: {vault: "{{inputs.vault}}", target: "{{inputs.doc}}--prep", source_doc_ids: "{{linked.doc_ids}}", purpose: Prep, max_tokens: 50}}
output_shape: {type: object, required: [write_back], properties: {write_back: {type: object, required: [doc_id], properties: {doc_id: {type: string}}}}}
write_back: {sink: "{{default_sink}}", document_kind: brief, properties: {target: "{{inputs.doc}}--prep"}, body_from: "{{compiled.body}}"}
"""


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    notes = [
        ("x://a", "main", 1, "meet/a.md", "A", '{"project":"atlas"}', "h1", DAY, None, None, None, None),
        ("x://b", "main", 2, "p/b.md", "B", '{"project":"other"}', "h2", DAY, None, None, None, None),
        ("x://c", "main", 3, "p/c.md", "C", '{"project":"atlas"}', "h3", DAY + dt.timedelta(1), None, None, None, None),
        ("x://m", "main", 4, "_memory/m.md", "M", "{}", "h4", DAY, "active", "fact", "direct", DAY),
        ("x://o", "main", 5, "_memory/o.md", "O", "{}", "h5", DAY, "superseded", "fact", "direct", DAY),
    ]
    noted = spark.createDataFrame(notes, "id string, vault string, note long, path string, title string, props string, hash string, mtime timestamp, status string, type string, confidence string, observed_at timestamp").withColumns({"valid_from": F.lit(None).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    texts = [(1, 10, "red fox in the meeting"), (1, 11, "nothing at all here"), (2, 20, "red red fox project"), (3, 30, "blue fox"), (4, 40, "red fox remembered well"), (5, 50, "red fox forgotten")]
    chunks = spark.createDataFrame([("main", n, c, t, None, None, "superseded" if c == 50 else None) for n, c, t in texts], "vault string, note long, chunk long, text string, vector array<double>, props string, status string").withColumns({"valid_from": F.lit(None).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp"), "mtime": F.lit(DAY)})
    # Edges are of whole numbers for clusters; ids of notes are texts, so this library numbers them.
    number = noted.select(F.col("id").alias("name"), F.col("note").alias("id"))
    links = spark.createDataFrame([(1, 2, "wikilink"), (1, 3, "wikilink"), (3, 2, "mention")], "src long, dst long, type string")
    sections = spark.createDataFrame([("main", 1, 1, None, 0, 1, 10, 11, "all"), ("main", 1, 2, 1, 1, 2, 10, 10, "first"), ("main", 2, 3, None, 0, 1, 20, 20, "only")], "vault string, note long, id long, parent long, pos long, level int, low long, high long, heading string")
    briefs = spark.createDataFrame([("t", 1, DAY, False, False), ("t", 2, DAY - dt.timedelta(90), False, False), ("u", 3, DAY, False, True)], "target string, brief long, compiled_at timestamp, superseded boolean, stale boolean")
    index = postings.build(chunks, str(tmp_path_factory.mktemp("index") / "i"), "chunk", "text", "vault")
    numbered = noted.drop("id").join(number, noted["note"] == number["id"]).drop("name")
    return verbs.Library(spark, numbered, chunks, index, links, sections, briefs, F.expr("timestamp'2024-05-03'"), ["_memory/"], ["main"])


def ids(told):
    return sorted(r["id"] for r in told["doc_ids"].collect())


def test_eleven_verbs(library):
    call = library.verbs()
    assert set(call) == set(verbs.NAMES) and len(call) == 11
    assert ids(call["read_note"](2)) == [2] and ids(call["read_note"](77)) == []
    assert ids(call["search_hybrid"]("red FOX", "main")) == [1, 2, 4] and call["search_hybrid"]("red fox", limit=1)["rows"].count() == 1
    assert ids(call["expand"]([1])) == [1, 2, 3] == ids(call["expand"](call["read_note"](1)["doc_ids"], hops=2))
    assert ids(call["cluster"](seed_doc_ids=[1])) == [1, 2, 3] and {r["cluster"] for r in call["cluster"](query="project fox")["rows"].collect()} == {1}
    with pytest.raises(ValueError, match="both_seeds"):
        call["cluster"](seed_doc_ids=[1], query="x")
    assert ids(call["recall"]("red fox")) == [4] and ids(call["recall"]("red fox", confidence="direct", types=["fact"], max_age_days=1)) == []
    compiled = call["compile_brief"]("t", [1, 3], "Prep", "main", 100)
    assert compiled["rows"].first()["hashes"] == {1: "h1", 3: "h3"} and compiled["body"].first()[0] == "# Prep\n\n- [[meet/a.md]] A\n- [[p/c.md]] C"
    assert call["compile_brief"]("t", [1, 99])["rows"].first()["error"] == "source_not_found"
    assert tuple(call["get_brief"]("t")["rows"].first()) == ("t", 1, "ok") and call["get_brief"]("u")["rows"].first()["state"] == "stale"
    assert ids(call["query_frontmatter"]({"project": "atlas"})) == [1, 3] and ids(call["query_frontmatter"](limit=1)) == [3]
    assert ids(call["list_backlinks"](2)) == [1, 3]
    assert [(r["id"], r["chunks"]) for r in call["get_outline"](1)["rows"].collect()] == [(1, [10, 11]), (2, [10])]
    found = call["search_sections"]("red fox", "main", 5)["rows"].collect()
    assert sorted((r["heading"], r["chunks"], r["snippet"]) for r in found) == [("first", [10], "red fox in the meeting"), ("only", [20], "red red fox project")]
    assert [r["score"] for r in found] == sorted([r["score"] for r in found], reverse=True)
    for verb in ("search_hybrid", "recall", "search_sections"):
        with pytest.raises(ValueError, match="vault_required"):
            call[verb]("red", "absent")


def test_a_workflow_file_runs(library):
    flow = workflow.parse(FLOW.replace('"#/types/DocId"', '"#/types/DocId", type: integer, pattern: ""'))
    call, written = library.verbs(), []

    def write(sink, kind, properties, body):
        written.append((sink, kind, properties, body.first()[0]))
        return {"doc_id": f"{sink}/1"}

    out = flow.run(call, {"vault": "main", "doc": 1}, write)
    assert ids(out["linked"]) == [1, 2, 3] and out["clustered"]["rows"].count() == 3 and out["write_back"] == {"doc_id": "_memory/_briefs/1"}
    assert written == [("_memory/_briefs", "brief", {"target": "1--prep"}, "# Prep\n\n- [[meet/a.md]] A\n- [[p/b.md]] B\n- [[p/c.md]] C")]
    with pytest.raises(ValueError, match="write_back.doc_id is missing"):
        flow.run(call, {"vault": "main", "doc": 1}, lambda *a: {})
    assert "write_back" not in flow.run(call, {"vault": "main", "doc": 1, "hops": 2})


@pytest.mark.parametrize(
    ("inputs", "wrong"),
    [
        ({"vault": "v"}, ["input 'doc' is missing"]),
        ({"vault": "v", "doc": "no-scheme"}, ["input 'doc' doesn't fit"]),
        ({"vault": 3, "doc": "x://a", "hops": 3, "typo": 1}, ["input 'typo' isn't known", "input 'vault' is no string", "input 'hops' is more than 2"]),
        ({"vault": "v", "doc": "x://a", "hops": True}, ["input 'hops' is no integer"]),
        ({"vault": "v", "doc": "x://a", "sink": "elsewhere"}, ["input 'sink' is no registered sink"]),
        ({"vault": "v", "doc": "x://a", "hops": 2, "sink": "default_sink"}, []),
    ],
)
def test_inputs_are_typed(inputs, wrong):
    flow = workflow.parse(FLOW)
    got = flow.unfit(inputs, flow.sinks)
    assert len(got) == len(wrong) and all(any(g.startswith(w) for g in got) for w in wrong)


def test_files_are_checked_before_a_run():
    call = dict.fromkeys(verbs.NAMES, lambda **a: None)
    assert workflow.parse(FLOW).problems(call) == []
    assert workflow.parse(FLOW.replace("verb: expand", "verb: explode")).problems(call) == ["verb 'explode' isn't known"]
    assert workflow.parse(FLOW.replace("{{linked.doc_ids}}\", method", "{{later.doc_ids}}\", method")).problems(call) == ["step 'clustered' uses 'later', which isn't there"]
    assert workflow.parse(FLOW.replace("{{compiled.body}}", "{{gone.body}}")).problems(call) == ["the write-back uses 'gone', which isn't there"]
    for broken in (FLOW.replace("version: 1", "version: 2"), FLOW.replace("#/types/DocId", "#/types/Nothing"), "a: 1"):
        with pytest.raises(ValueError):
            workflow.parse(broken)
    schema = {"type": "object", "properties": {"n": {"type": ["number", "null"], "enum": [1, None]}, "xs": {"type": "array", "items": {"type": "string", "minLength": 2}}}, "additionalProperties": False}
    assert workflow.misfits({"n": 1, "xs": ["ab"]}, schema, "v") == [] and workflow.misfits({"n": 2, "xs": ["a", 3], "y": 0}, schema, "v") == ["v.n is none of [1, None]", "v.xs[0] is too short", "v.xs[1] is no string", "v.y isn't known"]
