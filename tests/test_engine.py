import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestack.functions import text
from lodestack.operators import graph, predicates
from lodestack.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(value(x) for x in r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((tuple(value(x) for x in r) for r in want.fetchall()), key=repr)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["vault", "chunk", "score", "best_rank", "text_rank", "near_rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_property_filters(spark):
    rows = spark.createDataFrame([(1, '{"a":"x","t":["u","v"],"n":null}'), (2, '{"a":"y","b":{"c":[5]}}'), (3, None)], "id int, p string")
    ids = lambda where: sorted(r[0] for r in rows.filter(predicates.match_props("p", where)).collect())
    assert ids({"a": "x"}) == [1]
    assert ids({"n": None, "a": "x"}) == [1]
    assert ids({"a": {"$in": ["x", "y"]}}) == [1, 2]
    assert ids({"a": {"$in": []}}) == []
    assert ids({"t": {"$contains": "v"}}) == [1]
    assert ids({"a": {"$contains": "x"}}) == []
    assert ids({"b.c.0": 5}) == [2] and ids({"b.c.0": "5"}) == []
    assert ids({"b": {"$exists": False}}) == [1, 3]
    with pytest.raises(ValueError):
        predicates.json_path("a b")


def test_globs(spark):
    import re

    assert re.search(predicates.glob_regex("_memory/**"), "_memory/a/b.md") and re.search(predicates.glob_regex("_memory/**"), "_memory")
    assert not re.search(predicates.glob_regex("*.md"), "a/b.md") and re.search(predicates.glob_regex("a/?.md"), "a/b.md")


def test_text_functions():
    doc = "# Top\n\nSee [[Note#Part|shown]] and `[[no]]`.\n```\n# code [[no]]\n```\n## Relations\n- uses [[Other]]\n- [fact] it holds\n"
    assert text.headings(doc) == [(0, 1, "Top"), (doc.index("## Rel"), 2, "Relations")]
    assert [w["target"] for w in text.wikilinks(doc)] == ["Note", "Other"]
    assert [r[:2] for r in text.relations(doc)] == [("uses", "Other")]
    assert [r[:4] for r in text.statements(doc)] == [(9, 9, "fact", "it holds")]
    assert text.heading_paths(doc)[1][1] == ["Top", "Relations"]


def test_chunks_cover():
    body = "".join(f"Sentence number {i} is here. " for i in range(400))
    parts = text.chunks(body)
    assert parts[0][0] == 0 and parts[-1][1] == len(body) and all(b - a <= 1800 for a, b, _ in parts)
    assert all(parts[i + 1][0] <= parts[i][1] for i in range(len(parts) - 1))


def test_expand_excludes_seeds(spark):
    edges = spark.createDataFrame([(1, 2, "t"), (2, 3, "t"), (4, 1, "u")], "src long, dst long, type string")
    rows = graph.expand(edges, spark.createDataFrame([(1,)], "seed long"), 2).orderBy("node").collect()
    assert [(r["node"], r["hop"]) for r in rows] == [(2, 1), (3, 2), (4, 1)]
    assert predicates.CONFIDENCE["direct"] == 3 and F is not None


def test_properties_are_parsed_once_a_row(spark):
    import json

    rows = [(i, json.dumps(p) if isinstance(p, dict) else p) for i, p in enumerate([{"a": 1}, {"a": "1"}, {"a": None}, {}, None, "{", {"a": [1, None]}, {"a": {"b": True}}, {"a": 3.0, "b": 1}])]
    df = spark.createDataFrame(rows, "i int, p string")
    ids = lambda test: [r[0] for r in df.filter(test).orderBy("i").collect()]
    told = lambda **where: ids(predicates.match_props("p", where))
    assert told(a={"$in": [1, 3, "1"]}) == [0, 1, 8] and told(a={"$in": []}) == [] and told(a=None) == [2, 3, 4, 5]
    assert told(a={"$exists": True}) == [0, 1, 6, 7, 8] and told(a={"$exists": False}) == [2, 3, 4, 5] and told(a={"$contains": 1}) == [6]
    assert told(a=3, b=1) == [8] and told() == list(range(9)) and ids(predicates.match_props("p", {"a.b": True})) == [7]
    assert ids(predicates.matches_text("p", "a", "1")) == [0, 1, 6]
    for test in (predicates.match_props("p", {"a": {"$in": [1, 3, 4, 11]}, "b": 1}), predicates.matches_text("p", "a", "1")):
        plan = df.filter(test)._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
        assert plan.count("parsejson") == 1


def test_texts_become_python_objects_a_few_at_a_time():
    pa = pytest.importorskip("pyarrow")
    from lodestack.functions import hashing

    texts, sizes = pa.array(["x" * (i % 7) if i % 5 else None for i in range(150)]).slice(3), []

    class Told:
        def __len__(self):
            return len(texts)

        def slice(self, at, n):
            sizes.append(n)
            return texts.slice(at, n)

    out = hashing.one_by_one(lambda t: t and t.upper())(Told())
    assert out.to_pylist() == [t and t.upper() for t in texts.to_pylist()] and sizes == [64, 64, 64]
    assert hashing.one_by_one(str)(texts.slice(0, 0)).type == pa.string()
