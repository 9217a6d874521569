import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestack.functions import vectors
from lodestack.operators import hybrid, postings
from lodestack.operators.hybrid import Condition

CHUNK = "vault string, note long, chunk long, text string, vector array<double>, props string, status string, valid_from timestamp, valid_to timestamp, mtime timestamp"
DAY = dt.datetime(2024, 1, 1)
def now():
    return F.expr("timestamp'2024-01-01'")


ROWS = [
    ("a", 1, 1, "red fox in the wood, all day", [0.0, 0.0], '{"class":"Person","authoritative":true}', None, None, None, DAY),
    ("a", 1, 2, "red red fox", [5.0, 0.0], '{"class":"Person"}', None, None, None, DAY),
    ("a", 2, 3, "blue fox sleeps under a tree", [0.1, 0.0], "{}", None, None, None, DAY - dt.timedelta(30)),
    ("b", 3, 4, "red fox far away from the others", [0.0, 1.0], None, None, None, None, DAY),
    ("b", 4, 5, "red fox long gone", [0.0, 0.0], None, "superseded", None, None, DAY),
    ("b", 5, 6, "red fox not yet", [0.0, 0.0], None, None, dt.datetime(2030, 1, 1), None, DAY),
    ("b", 6, 7, "red fox no more", [0.0, 0.0], None, None, None, DAY, DAY),
    ("b", 7, 8, None, None, None, None, None, None, DAY),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    chunks = spark.createDataFrame(ROWS, CHUNK)
    return chunks, postings.build(chunks, str(tmp_path_factory.mktemp("index") / "i"), "chunk", "text", "vault")


def found(store, **options):
    chunks, index = store
    terms, vector = options.pop("terms", ["red", "fox"]), options.pop("vector", [0.0, 0.0])
    return [(r["chunk"], round(r["score"], 4)) for r in hybrid.search(chunks, index, terms, vector, now(), **options).collect()]


def test_lists_are_fused_for_each_vault(store):
    # vault a: words 2, 1; vectors 1, 3, 2. vault b: chunk 4 first in both lists
    one, two, three = 1 / 61, 1 / 62, 1 / 63
    assert found(store) == [(4, round(2 * one, 4)), (1, round(one + two, 4)), (2, round(one + three, 4)), (3, round(two, 4))]
    assert [c for c, _ in found(store, vector=None)] == [2, 4, 1]
    assert [c for c, _ in found(store, vaults=["a"], k=2)] == [1, 2]
    assert found(store, vaults=[]) == [] and found(store, terms=[]) == [] and found(store, k=0) == []
    assert 5 in [c for c, _ in found(store, superseded=True)]


def test_scores_change_by_age_properties_and_authority(store):
    fresh = dict(found(store, recency=1.0, half_life=30.0))
    assert fresh[3] == round(1 / 62 + 0.367879, 4) and fresh[4] == round(2 / 61 + 1, 4)  # an e-folding time
    assert found(store, authority=0.5)[0][0] == 1
    assert [c for c, _ in found(store, boosts=[Condition("class", "Person", 0.5)])][:2] == [1, 2]
    assert [c for c, _ in found(store, only=[Condition("class", "Person"), Condition("authoritative", "true")])] == [1]
    assert [c for c, _ in found(store, notes=True)] == [4, 1, 3]


def test_reranking(store):
    longest = lambda q, texts: [len(t) for t in texts]
    assert [c for c, _ in found(store, scorer=longest)] == [4, 1, 3]  # chunk 2 is too short to be read
    plain = [c for c, _ in found(store)]

    def fails(q, texts):
        raise RuntimeError(q)

    assert [c for c, _ in found(store, scorer=fails)] == plain == [c for c, _ in found(store, scorer=lambda q, texts: [1.0])]
    assert [c for c, _ in found(store, scorer=vectors.by_norm(lambda texts: [[len(t)] for t in texts]))] == [1, 3, 4]
    assert vectors.by_pair(lambda q, t: [0.0, 1e9])("q", ["a", "b"]) == [0.5, 1.0]


def test_alias_comes_first(spark, store):
    chunks, _ = store
    aliases = spark.createDataFrame([("a", 2, " The Tree "), ("b", 4, "gone"), ("b", 3, "the tree"), ("a", 1, "x")], "vault string, note long, alias string")
    hits = chunks.filter("chunk in (1, 3, 4)").select("vault", "note", "chunk", (F.lit(1.0) / F.col("chunk")).alias("score"))
    order = lambda q, h=hits, k=10: [(r["chunk"], r["score"]) for r in hybrid.inject_alias(h, q, aliases, chunks, now(), k).orderBy("place").collect()]
    assert order("the tree")[0][0] == 3 and len(order("THE TREE")) == 3
    assert order("the tree", hits.filter("note = 1")) == [(3, 1.0), (1, 1.0)] and order("the tree", hits.filter("note = 1"), 1) == [(3, 1.0)]
    assert [c for c, _ in order("gone")] == [1, 3, 4] == [c for c, _ in order("nothing")]


def test_index_segments(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, "blue"), (4, None)], "id long, text string")
    index = postings.build(docs, str(tmp_path / "i"), "id", "text")
    index.replace(spark.createDataFrame([(2, "green fox"), (9, "red")], "id long, text string"), spark.createDataFrame([(3,)], "key long"), "id", "text")
    index.replace(spark.createDataFrame([(9, "red fox fox")], "id long, text string"), spark.createDataFrame([(77,)], "key long"), "id", "text")
    whole = postings.build(spark.createDataFrame([(1, "red fox"), (2, "green fox"), (9, "red fox fox"), (4, None)], "id long, text string"), str(tmp_path / "w"), "id", "text")
    rows = lambda i, *q, **o: [tuple(r) for r in i.bm25(q, 10, **o).collect()]
    for words in (("red",), ("fox", "red"), ("blue",), ("green", "none")):
        assert rows(index, *words) == rows(whole, *words)
    assert rows(index, "red", "fox", every=True) == rows(whole, "red", "fox", every=True)
    sums = lambda i, name, by: sorted(tuple(r) for r in i.read(name).groupBy(by).agg(*[F.sum(c) for c in (["df"] if name == "terms" else ["n", "words"])]).collect() if r[1])
    assert sums(index, "terms", "term") == sums(whole, "terms", "term") and sums(index, "stats", "vault") == sums(whole, "stats", "vault")


def test_vectors(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], [0.0, 0.0])], "t array<array<double>>, m array<int>, z array<double>")
    got = row.select(vectors.mean_pool("t", "m").alias("p"), vectors.unit("z").alias("z"), vectors.sigmoid(F.lit(0.0)).alias("s")).first()
    assert got["p"] == [2.0, 3.0] and got["z"] == [0.0, 0.0] and got["s"] == 0.5
