"""What the build of an index reads and writes: words of texts as they are, numbers in narrow kinds, texts stored once."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.operators import fulltext, postings


def test_words_are_spotted_in_texts_as_they_are(spark):
    texts = ["", "Red reKéfox, İI the RED", "", "9AK", "a", "ÀB c", "Z"]
    sizes, terms, which, owner, place = postings.spotted(pa.array(["cut me", *texts]).slice(1))
    got = [[] for _ in texts]
    for w, o, p in zip(which, owner, place, strict=True):
        assert p == len(got[o])
        got[o].append(terms[int(w)].as_py())
    lowered = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "n int, t string").orderBy("n").select(F.lower("t")).collect()]
    assert got == [[w for w in re.split("[^a-z0-9]+", t) if w] for t in lowered] and got[1][:2] == ["red", "rek"] and sizes.tolist() == [len(g) for g in got]


def test_no_other_sign_becomes_a_letter(spark):
    signs = spark.range(0x80, 0x110000).filter("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert {r["c"] for r in signs.filter(F.lower("c").rlike("[a-z0-9]")).collect()} == set(postings.FOREIGN)


def test_numbers_take_the_narrowest_kind_that_holds_them():
    parts = [np.array([0, 3, 255]), np.array([256, 65535]), np.array([65536, 7, 1 << 30]), np.array([], int)]
    lists = pa.concat_arrays([postings._narrow(np.array([0, 1, len(p)]) if len(p) else np.array([0, 0]), p) for p in parts])
    counts = np.array([1, 2, 1, 1, 1, 2, 0])
    assert [len(v) for v in lists.to_pylist()] == [1, 2, 2, 2, 4, 8, 0]
    assert postings._wide(lists, counts).tolist() == [0, 3, 255, 256, 65535, 65536, 7, 1 << 30]
    assert postings._wide(lists.slice(2), counts[2:]).tolist() == [256, 65535, 65536, 7, 1 << 30]


def test_texts_are_stored_once_and_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SLOT_DOCS", 40)
    docs = spark.createDataFrame([(i, None if i % 17 == 5 else f"Red w{i} {'far ' * 300 if i == 3 else ''}the-END", f"v{i % 2}") for i in range(200)], "id long, text string, vault string")
    index = postings.build(docs, str(tmp_path / "i"), "id", "text", "vault")
    view = index.view()
    assert view.segments[0]["slots"] == 5 and set(view.read("forward").columns) == {"key", "vault", "text", "slot", "segment"}
    whole = index._dealt(view.segments[0]["id"])
    assert sorted(r["key"] for r in whole.collect()) == list(range(200)) and whole.rdd.getNumPartitions() >= 5
    scan = {(r["key"], r["vault"], r["len"]) for r in postings.forward_of(postings.told(docs, "id", "text", "vault")).collect()}
    assert {(r["key"], r["vault"], r["len"]) for r in view.held(docs.select(F.col("id").alias("key"))).collect()} == scan
    assert {r["vault"]: (r["n"], r["words"]) for r in view.read("stats").collect()} == {v: (100, sum(n for _, own, n in scan if own == v)) for v in ("v0", "v1")}
    assert fulltext.indexed(index, "NEAR(far end, 1)", None).collect()[0]["key"] == 3


def test_blocks_of_a_word_are_joined_in_its_range():
    told = lambda part: sorted((r["term"], r["vault"] or "", r["key"], r["len"], r["tf"], r["positions"]) for r in part.to_pylist())
    texts = [f"common w{k % 3}" + " common" * (300 if k == 7 else k % 2) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([None, "a", "b"] * 20), pa.array(range(60)), pa.array(texts), pa.array([k * 7 % 4 for k in range(60)])], names=["vault", "key", "text", "salt"])
    bounds = [("common", 1), ("common", 3), ("w1", 0)]
    runs = [postings._runs(batch.slice(at, 7), bounds) for at in range(0, 60, 7)]
    assert all(len(set(r.column("cut").to_pylist())) == r.num_rows for r in runs)
    made = []
    for cut in range(4):
        own = [r.filter(pa.compute.equal(r.column("cut"), cut)) for r in runs]
        (joined,) = postings._joined(iter(own))
        names = [(r["term"], r["vault"]) for r in joined.to_pylist()]
        assert len(names) == len(set(names)) and [t for t, _ in names] == sorted(t for t, _ in names)
        made += told(postings._unpacked(joined))
    assert sorted(made) == told(postings._postings(batch.select(["vault", "key", "text"]))) and list(postings._joined(iter([]))) == []


def test_keys_are_stored_above_the_least():
    lists = [[5], [-1, 254], [1 << 40, (1 << 40) + 256, 1 << 40], [0, 70_000], [-(1 << 62), (1 << 62) + 3], [-(1 << 63), (1 << 63) - 1], [7, 1 << 33]]
    part = pa.RecordBatch.from_arrays([pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["n", "keys"])
    stored = postings._stored(part)
    assert [len(b) - 8 for b in stored.column(1).to_pylist()] == [1, 2, 6, 8, 16, 16, 16]
    n = part.column(0).to_numpy()
    assert postings._keys(stored.column(1), n).to_pylist() == sum(lists, []) == postings._keys(part.column(1), n).to_pylist()
    assert postings._keys(stored.column(1).slice(3), n[3:]).to_pylist() == sum(lists[3:], [])
    assert postings._stored(part.slice(0, 0)).num_rows == 0 and postings._keys(stored.column(1).slice(0, 0), n[:0]).to_pylist() == []
    words = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([["k"]])], names=["n", "keys"])
    assert postings._stored(words) is words


def test_a_joined_block_ends_at_its_size(monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 10)
    monkeypatch.setattr(postings, "ROWS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(["v"] * 50), pa.array([f"k{i}" for i in range(50)]), pa.array(["red fox"] * 50)], names=["vault", "key", "text"])
    parts = list(postings._joined(postings._runs(batch.slice(at, 4)) for at in range(0, 50, 4)))
    rows = [r for p in parts for r in p.to_pylist()]
    assert len(parts) > 1 and max(r["n"] for r in rows) < 14 and [sum(r["n"] for r in rows if r["term"] == t) for t in ("fox", "red")] == [50, 50]
    assert sorted(k for r in rows if r["term"] == "red" for k in r["keys"]) == sorted(f"k{i}" for i in range(50))


def test_a_file_has_a_word_once_and_the_sample_reads_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SLOT_DOCS", 100)
    index = postings.build(spark.createDataFrame([(i, f"common w{i % 50} a{i}") for i in range(1000)], "id long, text string"), str(tmp_path / "i"), "id", "text")
    view = index.view()
    rows = view.read("postings").groupBy("term", "vault", F.col("_metadata.file_name").alias("file")).count()
    assert rows.filter("count > 1").count() == 0 and view.live().count() == 3000 and view.live(["w7"]).count() == 20
    monkeypatch.setattr(postings, "SAMPLE_DOCS", 20)
    segment, whole = view.segments[0]["id"], view.read("forward")
    drawn = index._drawn(segment, 1000)
    assert set(drawn.columns) >= {"vault", "key", "text"} and 20 <= drawn.count() < 500 and len(drawn.inputFiles()) < len(whole.inputFiles())
    assert postings.bounds_of(drawn, drawn.count(), 4) == sorted(postings.bounds_of(drawn, drawn.count(), 4))
