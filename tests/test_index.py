"""The stored index: searches against the scan, segments, merging, concurrent writers, and what is read."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import fulltext, postings
from lodestack.operators.manifest import Conflict, Manifest

WORDS = "red fox fog license version the of a blue liar lic under".split()
DOC = "id long, text string, vault string"
QUERIES = [
    "red", "red fox", "red-fox", "the-red-fox", "a/a", "fox OR cat", "(red OR blue) NOT (fox AND the)", "li*", "lic*", "NEAR(red fox, 1)", "NEAR(red fox the, 3)", "NEAR(a a, 0)", "red AND li* NOT under-the",
    "nothing", "", "NOT red", "zz* OR red", "the of a red fox", '"quoted: red" fox)',
]


def made(n, seed):
    rng = random.Random(seed)
    return [(i, None if i % 17 == 5 else " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "-"]) for _ in range(rng.randrange(0, 40))), f"v{i % 2}") for i in range(n)]


def rows(df):
    return sorted((r["key"] if "key" in r else r["id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = spark.createDataFrame(made(120, 1), DOC).repartition(3).cache()
    return docs, postings.build(docs, str(tmp_path_factory.mktemp("index") / "i"), "id", "text")


@pytest.mark.parametrize("query", QUERIES)
def test_index_equals_scan(built, query):
    docs, index = built
    assert rows(fulltext.indexed(index, query, None)) == rows(fulltext.search(docs, query, "id", "text", 1000))
    keep = docs.filter("id % 3 = 0").select(F.col("id").alias("key"))
    assert rows(fulltext.indexed(index, query, None, keep)) == rows(fulltext.search(docs, query, "id", "text", 1000, F.col("id") % 3 == 0))


def test_vaults_count_for_themselves(spark, built, tmp_path):
    docs, _ = built
    index = postings.build(docs, str(tmp_path / "i"), "id", "text", "vault")
    for v in ("v0", "v1"):
        own = [(r["key"], r["score"]) for r in fulltext.indexed(index, "li* OR the-red", None).filter(F.col("vault") == v).collect()]
        assert sorted(own) == rows(fulltext.search(docs.filter(F.col("vault") == v), "li* OR the-red", "id", "text", 1000))
    assert [r["key"] for r in fulltext.indexed(index, "red", 3).collect()] == [r["key"] for r in fulltext.indexed(index, "red", None).orderBy(F.desc("score"), "vault", "key").limit(3).collect()]


def test_searches_read_the_files_of_their_words_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common w{i:05d}") for i in range(4000)], "id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = postings.build(docs, str(tmp_path / "i"), "id", "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    view = index.view()
    files = lambda terms, prefixes=(): sum(map(len, view._files("postings", terms, prefixes).values()))
    whole = len(view.read("postings").inputFiles())
    assert whole >= 4 and files(["w00001"]) == 1 and files([], ["w0000"]) <= 2 and files(["absent"]) == 0
    assert files(["common"]) > 1  # a frequent word fills several files
    opened = fulltext.indexed(index, "NEAR(fox w00001, 5)").inputFiles()
    assert opened and all("/segments/" in f for f in opened) and len([f for f in opened if "/postings/" in f]) <= 2  # no text is read
    assert rows(fulltext.indexed(index, "w0000*")) == rows(fulltext.search(docs, "w0000*", "id", "text"))


def changed(spark, index, docs, turn, **options):
    """Replace, add and remove documents of `docs` (a dict), in the index too."""
    fresh = {turn * 3 + k: t for k, (_, t, _) in enumerate(made(4, 100 + turn))}
    gone = [turn * 5 + 60, 500]
    docs.update(fresh)
    for g in gone:
        docs.pop(g, None)
    frame = spark.createDataFrame(sorted(fresh.items()), "id long, text string")
    return index.replace(frame, spark.createDataFrame([(g,) for g in gone], "key long"), "id", "text", **options)


def test_segments_are_merged_and_stay_equal(spark, tmp_path):
    docs = {i: t for i, t, _ in made(100, 2)}
    whole = lambda: spark.createDataFrame(sorted(docs.items()), "id long, text string")
    index = postings.build(whole(), str(tmp_path / "i"), "id", "text")
    merges = 0
    for turn in range(5):
        assert changed(spark, index, docs, turn)
        merges += index.merge(fan=3)
    view = index.view()
    assert merges >= 1 and len(view.segments) < 6
    for query in ("red-fox OR li*", "NEAR(red fox, 2)", "the NOT red"):
        assert rows(fulltext.indexed(index, query, None)) == rows(fulltext.search(whole(), query, "id", "text", 1000))
    fresh = postings.build(whole(), str(tmp_path / "w"), "id", "text").view()
    told = lambda v: (sorted(map(tuple, v.dictionary().collect())), sorted(map(tuple, v.stats().collect())), sorted((r["key"], r["len"], sorted(r["terms"])) for r in v.held(v.read("forward").select("key").distinct()).collect()))
    assert told(view) == told(fresh)
    old = index.view(1)
    assert old.version == 1 and len(old.segments) == 1 and old.bm25(["red"], 3).count() == 3  # an older version can be read until it's removed
    assert index.vacuum() > 0 and rows(fulltext.indexed(index, "red", None)) == rows(fulltext.search(whole(), "red", "id", "text", 1000))
    while index.merge(fan=2):
        pass
    assert told(index.view()) == told(fresh)


def test_of_two_writers_one_wins(spark, tmp_path):
    index = postings.build(spark.createDataFrame([(1, "red"), (2, "fox")], "id long, text string"), str(tmp_path / "i"), "id", "text")
    base, none = index.view(), spark.createDataFrame([], "key long")
    assert index.replace(spark.createDataFrame([(3, "red red")], "id long, text string"), none, "id", "text", base=base)
    with pytest.raises(Conflict):
        index.replace(spark.createDataFrame([(4, "red red red")], "id long, text string"), none, "id", "text", base=base)
    assert sorted(r["key"] for r in index.bm25(["red"], 9).collect()) == [1, 3] and index.vacuum() == 0  # the loser left nothing
    with pytest.raises(Conflict):
        postings.build(spark.createDataFrame([(9, "x")], "id long, text string"), str(tmp_path / "i"), "id", "text")
    # A view doesn't change under its reader, and the loser may try again from the newest version.
    assert [r["key"] for r in base.bm25(["red"], 9).collect()] == [1]
    assert index.replace(spark.createDataFrame([(4, "red")], "id long, text string"), spark.createDataFrame([(1,)], "key long"), "id", "text")
    assert sorted(r["key"] for r in index.bm25(["red"], 9).collect()) == [3, 4]


def test_a_stream_batch_is_taken_once(spark, tmp_path):
    index = postings.build(spark.createDataFrame([(1, "red")], "id long, text string"), str(tmp_path / "i"), "id", "text")
    none = spark.createDataFrame([], "key long")
    one = spark.createDataFrame([(2, "red")], "id long, text string")
    assert index.replace(one, none, "id", "text", source="s", batch=0) and not index.replace(one, none, "id", "text", source="s", batch=0)
    assert index.replace(one, none, "id", "text", source="other", batch=0) and index.replace(one, none, "id", "text", source="s", batch=1)
    assert len(index.view().segments) == 4 and index.view().stats().first()["n"] == 2


def test_manifest_versions(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "m"))
    assert manifest.read() == (0, {"segments": [], "batches": {}})
    assert manifest.commit(0, {"segments": ["a"], "batches": {}}) == 1 and manifest.commit(1, {"segments": ["b"], "batches": {}}) == 2
    for base in (0, 1):
        with pytest.raises(Conflict):
            manifest.commit(base, {"segments": ["lost"], "batches": {}})
    assert manifest.read()[1]["segments"] == ["b"] and manifest.read(1)[1]["segments"] == ["a"] and manifest.versions() == [1, 2]


def test_empty_index(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "i"), "id", "text")
    assert index.bm25(["red"], 3).count() == 0 and fulltext.indexed(index, "red-fox OR li*").count() == 0
    index.replace(spark.createDataFrame([(1, "red fox"), (2, None)], "id long, text string"), spark.createDataFrame([(7,)], "key long"), "id", "text")
    assert [r["key"] for r in fulltext.indexed(index, "red-fox").collect()] == [1]
    index.replace(spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1,), (2,)], "key long"), "id", "text")
    assert fulltext.indexed(index, "red").count() == 0 and index.view().stats().count() == 0 and index.view().dictionary().count() == 0


def test_postings_are_made_whole_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "Red redéfox, the RED", "a"), (2, None, "a"), (3, "-", "b"), (4, "Key fox\n2.0", None)], DOC)
    rows = postings.postings_of(postings.prepared(docs, "id", "text", "vault"))
    got = {(r["term"], r["vault"], r["key"], r["len"], r["tf"], *r["positions"]) for r in rows.collect()}
    assert got == {("2", None, 4, 4, 1, 2), ("0", None, 4, 4, 1, 3), ("fox", None, 4, 4, 1, 1), ("key", None, 4, 4, 1, 0), ("fox", "a", 1, 5, 1, 2), ("red", "a", 1, 5, 3, 0, 1, 4), ("the", "a", 1, 5, 1, 3)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") == 1


@pytest.mark.parametrize("size", [1, 7, 1 << 21])
def test_slices_of_any_size_give_the_same_postings(spark, monkeypatch, size):
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(postings, "SLICE", size)
    texts = ["", "red fox", "", "a a b", "fox"]
    batch = pa.RecordBatch.from_arrays([pa.array(["v"] * 5), pa.array(range(5)), pa.array(["cut", *texts]).slice(1)], names=["vault", "key", "text"])
    made = [r for part in postings._by_slices(postings._postings)(iter([batch])) for r in part.to_pylist()]
    assert sorted((r["key"], r["term"], r["len"], *r["positions"]) for r in made) == [(1, "fox", 2, 1), (1, "red", 2, 0), (3, "a", 3, 0, 1), (3, "b", 3, 2), (4, "fox", 1, 0)]
    told = [(r["key"], r["len"], r["terms"]) for part in postings._by_slices(postings._forward)(iter([batch])) for r in part.to_pylist()]
    assert told == [(0, 0, []), (1, 2, ["fox", "red"]), (2, 0, []), (3, 3, ["a", "b"]), (4, 1, ["fox"])]


def test_postings_are_packed_into_blocks_by_word_and_range(spark, tmp_path):
    pa = pytest.importorskip("pyarrow")
    docs = [(k, v, f"common w{k % 3}" + " common" * (k % 2), k * 7 % 4) for k, v in enumerate([None, "a", "b"] * 20)]
    batch = pa.RecordBatch.from_arrays([pa.array([d[1] for d in docs]), pa.array([d[0] for d in docs]), pa.array([d[2] for d in docs]), pa.array([d[3] for d in docs])], names=["vault", "key", "text", "salt"])
    told = lambda part: sorted((r["term"], r["vault"] or "", r["key"], r["len"], r["tf"], r["positions"]) for r in part.to_pylist())
    plain = postings._postings(batch.select(["vault", "key", "text"]))
    bounds = [("common", 1), ("common", 3), ("w1", 0), ("w1x", 2)]
    blocks = postings._blocks(batch, bounds)
    assert told(postings._unpacked(blocks)) == told(plain) and blocks.num_rows < plain.num_rows // 4
    salts = {d[0]: d[3] for d in docs}
    for r in blocks.to_pylist():  # a posting's range depends on its word and document alone
        assert {sum(b <= (r["term"], salts[k]) for b in bounds) for k in r["keys"]} == {r["cut"]}
    again = postings._packed(plain.take(pa.compute.sort_indices(plain, [("term", "ascending"), ("vault", "ascending")])))
    assert told(postings._unpacked(again)) == told(plain)
    # A stored frequent word has far fewer rows than documents, and the words of the documents lie in several files of one folder.
    rows = spark.createDataFrame([(i, f"common w{i}") for i in range(2000)], "id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = postings.build(rows, str(tmp_path / "i"), "id", "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    view = index.view()
    assert view._of("postings", ["common"], []).count() < 100 and view.live(["common"], positions=False).count() == 2000
    assert len(view.read("forward").inputFiles()) > 1 and not any(s.getPath().getName() == "texts" for s in index.manifest.fs.listStatus(index.manifest._path(f"{index.path}/segments/{view.segments[0]['id']}")))
