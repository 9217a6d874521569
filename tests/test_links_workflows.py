import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import links
from lodestack.plans.workflow import Step, Workflow, describe


def test_mentions_take_the_longest_name_outside_code(spark):
    text = "# Road Map\nThe road map, and Roads; `road map` [[Road]] road-map ROAD MAP.\n```\nroad\n```\nroad"
    notes = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string").withColumn("text", links.prose("text"))
    names = spark.createDataFrame([(7, "Road"), (8, "road map"), (9, "map"), (6, "road")], "target long, name string")
    assert sorted(map(tuple, links.mention_edges(notes, names, "id", "text").collect())) == [(1, 2, 8), (1, 6, 6)]
    assert links.mentions(notes, names.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_mentions_equal_a_plain_scan(spark, block):
    rng = random.Random(1)
    names = ["road", "road map", "map-maker", "maps", "C++20", "node.js", ".net", "été d'or", "a b c", "++++", "road map of maps", "C++2", "tail c++"]
    bits = names + ["x", "-", "_", " ", ",", ".", "1", "é", "c++", "the", "roadmap", "\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "Road map"]
    known = [n.lower() for n in names if any(c.isalnum() for c in n)]
    free = lambda t, i: not 0 <= i < len(t) or not (t[i].isalnum() or t[i] in "_-")
    want = {}
    for r, t in enumerate(texts):
        i, low = 0, (t or "").lower()
        while i < len(low):
            n = max((n for n in known if low.startswith(n, i) and free(low, i - 1) and free(low, i + len(n))), key=len, default=None)
            if n:
                key = (r, [x.lower() for x in names].index(n))
                want[key] = want.get(key, 0) + 1
            i += len(n) if n else 1
    notes = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(99, "ROAD")], "target long, name string")
    got = {(r["id"], r["target"]): r["n"] for r in links.mentions(notes, table, "id", "text", block=block).collect()}
    assert got == want and len(want) > 200


def test_hyperlinks_and_property_references(spark):
    notes = spark.createDataFrame([(1, "[a](https://x.org/p), https://x.org/p.\nhttp://y.net!"), (2, None)], "id long, text string")
    assert sorted(map(tuple, links.hyperlinks(notes, "id", "text").collect())) == [(1, 1, "https://x.org/p"), (1, 2, "http://y.net")]
    props = spark.createDataFrame([("n", "lead", "[[Ann|A]]"), ("n", "owner", " ann "), ("n", "mood", "ann"), ("n", "owner", None)], "note string, key string, value string")
    aliases = spark.createDataFrame([(4, "Ann"), (3, "ANN")], "id long, alias string")
    assert sorted(map(tuple, links.property_refs(props, aliases, ["owner"]).collect())) == [("n", "lead", "Ann"), ("n", "owner", "3")]


def test_workflows_fill_templates_and_refuse_what_is_wrong(spark):
    verbs = {"rows": lambda n: spark.range(n), "count": lambda df: df.agg(F.count("*").alias("n"))}
    flow = Workflow("row-count", (Step("size", "literal", {"value": {"of": [3, 5]}}), Step("rows", "rows", {"n": "{{size.of[1]}}"}), Step("n", "count", {"df": "{{ rows }}"}), Step("told", "literal", {"value": "{{who}}: {{size.of[0]}}"})), required=("who",))
    out = flow.run(verbs, {"who": "Ann"})
    assert out["n"].collect()[0].n == 5 and out["told"] == "Ann: 3" and "2. `rows` by `rows`" in describe(flow)
    with pytest.raises(ValueError, match="'who' is missing"):
        flow.run(verbs, {})
    assert len(Workflow("Bad", (Step("a", "nothing"), Step("a", "literal")), output=("z",)).problems(verbs)) == 4
