"""Edge cases and brute-force equivalents of the training-data operators on small fixtures."""

import glob
import os
import random
import re
import zlib
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestack.llm import jaccard, langid, linededup, mixing, mtree, nndescent, orc_store, packing, queries, sharding, urlfilter
from lodestack.llm.common import components
from lodestack.llm.shingles import shingle_sets
from lodestack.llm.tokens import UnitTokenizer, load

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor, sit amet; " * 2000
TEXTS = [None, "", "   ", "a", "same text here now", "same text here now", LONG, "x\n\ny  z", "naïve café – déjà vu 日本語 it's we'll", "\ta\n", "<|endoftext|> a<|endoftext|>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i != 3 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all", "en", "s1", 12)]  # a repeated row, a null id
    return spark.createDataFrame(rows, DOC).withColumns({"start": F.lit("clash"), "score": F.lit(1), "shard": F.lit("x"), "copy": F.lit("c"), "n_lines": F.lit("l"), "rule": F.lit("r")})


def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("limit", [3, 40, 300_000])
def test_units_kept_in_little_room_give_the_same_ids(path, limit):
    encoder = UnitTokenizer(path, limit)
    assert encoder.mark is not None
    for turn in range(6):
        texts = [f"the same words {turn} and {turn * 7}, <|endoftex t|> a<|end", " \x01 x \x01", "long" * 200 * turn, "", f"{turn}\nnew\nlines", "|endoftext|> b <|"]
        ids, offsets = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == plain(path, texts)
        assert encoder.units.n == len(encoder.units.at)


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(alphabet=st.sampled_from("ab'sẞé́ \n\t .,!?\u00a0\u3000\u0085x12日–\x01"), max_size=40), st.text(max_size=30)), min_size=1, max_size=5))
def test_cut_encoding_equals_whole(path, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, at = load(path).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == plain(path, texts)


@cache
def fresh(path):
    return Tokenizer.from_file(path)


def plain(path, texts):
    """The library's own ids, by a tokenizer that nothing of the package has touched."""
    return [fresh(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_have_the_ids_of_the_library():
    texts = ["a <|endoftext|> b", None, "no such token, here", "<|startoftext|>it's<|endoftext|>", "", "<|ENDOFTEXT|> x <|endoftext |>"]
    for path, first in ((BYTE, [64, 220, 50256, 275]), (WORD, [320, 49407, 321])):
        ids, at = load(path).encode(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got[0] == first and got == plain(path, [t or "" for t in texts])


def test_query_digests_equal_a_fresh_tokenizer(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    coded = {i: plain(BYTE, [t])[0] + [0] for i, t in texts.items()}
    rows = queries.op1_packing(spark, "/root/testdata/sf0.001").collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert all(r["ids_crc32"] == crc(coded[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(coded[r["doc_id"]]) for r in rows)
    assert sum(r["length"] for r in rows) == sum(map(len, coded.values()))
    at, want = 0, set()
    for i in sorted(texts):
        ids = plain(WORD, [texts[i]])[0] + [2]
        want.add((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert {tuple(r) for r in queries.op4_orc_tokens(spark, "/root/testdata/sf0.001").collect()} == want


def test_orc_files_hold_stripes_and_prune(spark, tmp_path):
    docs = spark.range(24000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)).cast("string") for i in range(4)]).alias("text"))
    path = str(tmp_path / "t")
    orc_store.write_tokens(docs, path, WORD, files=2, stripe_bytes=1 << 16, row_index_stride=1000)
    files = [orc.ORCFile(f) for f in glob.glob(f"{path}/*.orc")]
    assert len(files) == 2 and all(f.nstripes > 1 for f in files) and sum(f.read_stripe(i).num_rows for f in files for i in range(f.nstripes)) == 24000
    one = spark.read.orc(path).filter("doc_id = 77")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()


def test_packing(spark, docs):
    rows = packing.pack(docs, BYTE, window=64, buffer=4).collect()
    want = [tuple(plain(BYTE, [t or ""])[0] + [0]) for t in [*TEXTS, TEXTS[4], "no id at all"]]
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, t in enumerate(TEXTS):
        if i != 4:
            assert sum((x for _, x in sorted(by_doc[i])), []) == list(want[i])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty(spark), BYTE).count() == 0


def test_tightest_window():
    tree = packing.OpenWindows(10)
    for room, w in ((3, 0), (7, 1), (10, 2)):
        tree.put(room, w)
    assert [tree.tightest(n) for n in (4, 3, 4, 11 - 1)] == [(7, 1), (3, 0), (10, 2), None]


def test_orc_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    orc_store.write_tokens(docs, path, WORD, files=3)
    rows = orc_store.digest_tokens(orc_store.read_tokens(spark, path)).collect()
    at = 0
    order = sorted([(r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in docs.select("doc_id", "text").collect()], key=lambda x: (x[0], x[1] or ""))
    for got, (i, t) in zip(sorted(rows, key=lambda r: r["start"]), order, strict=True):
        ids = np.array(plain(WORD, [t or ""])[0] + [2], "<u4")
        assert (got["doc_id"] if got["doc_id"] is not None else -1, got["start"], got["n_tokens"], got["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    orc_store.write_tokens(empty(spark), str(tmp_path / "e"), WORD)
    assert orc_store.digest_tokens(orc_store.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_language_accuracy_and_cases(spark, docs):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(sf.filter(~langid.held_out()))
    rows = langid.predict(sf, model).filter(langid.held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert rows["right"] > 0.97
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2)) and got[6]["lang_pred"] in model.labels
    assert got[3]["lang_pred"] in model.labels and got[3]["score"] > 0  # one letter
    assert langid.score(pa.array([" a", "x", " a", "a"]), model)[0][::2] == langid.score(pa.array(["a", "a"]), model)[0]
    nothing = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_jaccard_equals_brute_force(spark, docs):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(1, 60))] for _ in range(25)]
    texts = list(TEXTS)
    for words in base:
        for _ in range(8):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice("klmno")
            texts.append(rng.choice([" ", "\n"]).join(w).swapcase())
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = []
    for t in texts:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(rows, leaders=2, block_shingles=64).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert jaccard.jaccard_classes(empty(spark)).count() == 0
    small = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(docs).collect()}
    assert small[5] == 4 and small[0] == 0 and small[None] is None


def test_shingles_of_short_texts():
    value, at = shingle_sets(pa.array(["a b", "A  B", "a b c", None, " "]), 5)
    assert np.diff(at).tolist() == [1, 1, 1, 0, 0] and value[0] == value[1] != value[2]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_line_dedup_both_ways(spark, docs):
    rows = [(i, f"body {i}\nAll rights  \n\nend {i}", f"s{i}") for i in range(6)] + [(9, "copy a\ncopy b", f"s{i}") for i in range(8)]
    rows += [(10, None, None), (11, "", "s1"), (12, "body 0\ncopy a", "s1"), *[(20 + i, "four sites\nnull site", f"s{i}" if i else None) for i in range(4)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (1000, 0):
        got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(frame, max_lookup=most).collect()}
        assert got[3] == "body 3\n\nend 3" and got[9] == "" and got[10] is None and got[11] == "" and got[12] == "body 0" and got[21] == "four sites\nnull site"
        got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(frame, max_lookup=most, spread=0.25).collect()}
        assert got[3] == "body 3\n\nend 3" and got[9] == "copy a\ncopy b"
    assert linededup.line_dedup(docs).count() == docs.count() and linededup.line_dedup(empty(spark)).count() == 0


BLOCK = ["Menu home", "About us", "Contact here", "body {}", "Share this", "All rights reserved", "Cookie notice", "end {}"]


def test_every_line_of_a_block_goes(spark):
    """Boilerplate with the same neighbours on every site, and a line on as many rows of one site."""
    rows = [(i, "\n".join(BLOCK).replace("{}", str(i)), f"s{i}") for i in range(40)] + [(100 + i, f"only here\nx {i}", "s1") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.line_dedup(frame, min_sites=5).collect()}
    spared = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.line_dedup(frame, min_sites=5, spread=0.25).collect()}
    assert spared == got == {i: (f"body {i}\nend {i}", 6) for i in range(40)} | {100 + i: (f"only here\nx {i}", 0) for i in range(40)}
    story = [[f"word{j} of line {k} tells more of it" for j in range(3)] for k in range(12)]
    near = [(i, "\n".join(" ".join(x) for x in story).replace(f"word1 of line {i % 12}", f"changed{i}"), f"s{i % 30}") for i in range(300)]
    copies = spark.createDataFrame(near, "doc_id long, text string, source string")
    assert linededup.line_dedup(copies, min_sites=5).filter("n_removed > 8").count() == 300 and linededup.line_dedup(copies, min_sites=5, spread=0.25).filter("n_removed > 0").count() == 0
    for n in (29, 30, 31):  # about a threshold where the sketches estimate
        lines = spark.range(n * 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("line "), F.col("id") % 3).alias("text"), F.floor(F.col("id") / 3).cast("string").alias("source"))
        assert linededup.boilerplate(lines, min_sites=30).count() == (3 if n >= 30 else 0)


def test_url_cases(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/en/12?q"), (4, "https://com/de/x"), (5, "http://xcom/de/x"), (6, "http://b.com"), (7, "x://y.org?/es/"), (8, "http://example.org/es/#a")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, queries.RULES).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.org", "/en/12", "example.org/en/1", "block"), 4: ("com", "/de/x", "com/de/", "block"),
        5: ("xcom", "/de/x", None, "allow"), 6: ("b.com", "", None, "allow"), 7: ("y.org", "", None, "allow"), 8: ("example.org", "/es/", "example.org/es/", "block"),
    }
    assert urlfilter.judge(pages, []).filter("rule is null and verdict = 'allow'").count() == 8
    assert urlfilter.judge(pages.limit(0), queries.RULES).count() == 0
    # Rules as rows, with repeated, contradicting and broken ones, by filters and by the join that stands in for filters that would be too large.
    table = spark.createDataFrame([*queries.RULES, *queries.RULES, ("com", "/fr/", "block"), (None, "/", "block"), ("org", None, "block"), ("org", "/", "other")], "host string, path string, verdict string")
    mine = lambda **o: {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, table, **o).collect()}
    want = {k: (*v[:3], "block" if v[2] == "com/fr/" else v[3]) for k, v in got.items()}
    assert mine() == want == mine(max_bits=8) == mine(max_levels=0)
    assert urlfilter.judge(pages, table, max_bits=8).columns == urlfilter.judge(pages, table).columns


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    listed = universe.filter("key % 7 = 0")
    cascade = urlfilter.Cascade(listed, universe, bits_per_key=2, hashes=1)
    assert len(cascade.levels) > 2
    got = urlfilter.with_words(universe, cascade.levels).filter(cascade.holds(F.col("key")))
    assert sorted(r["key"] for r in got.select("key").collect()) == sorted(r["key"] for r in listed.collect())


def test_mixing(spark, docs):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(many, weights={"big": 1.0, "small": 1.0}).groupBy("source").count().collect()}
    assert abs(n["big"] - 10000) < 500 and abs(n["small"] - 10000) < 500
    single = mixing.mix(many.filter("doc_id = 9").unionByName(many.filter("source = 'big'")), weights={"small": 1.0})
    assert abs(single.count() - 18001) < 900 and single.select("source").distinct().count() == 1
    rows = mixing.mix(docs, max_broadcast=0)
    assert sorted(map(str, rows.collect())) == sorted(map(str, mixing.mix(docs).collect()))
    # Weights of 0, and of sources that aren't there, leave nothing, whether a source has bytes or not; without weights one without bytes stays.
    assert mixing.mix(docs, weights={"s0": 0.0, "s1": 0.0}).count() == mixing.mix(docs, weights={"absent": 2.0}).count() == 0
    bare = spark.createDataFrame([(1, "", "x"), (2, None, "x"), (3, "text " * 50, "y")], "doc_id long, text string, source string")
    assert {r["source"] for r in mixing.mix(bare, weights={"y": 1.0}, epochs=9.0).collect()} == {"y"}
    drawn = lambda **o: sorted(r["doc_id"] for r in mixing.mix(bare, **o).filter("source = 'x'").collect())
    assert drawn(weights={"x": 1.0}) == drawn() and set(drawn()) <= {1, 2} and drawn()
    assert mixing.mix(empty(spark)).count() == 0


def test_hilbert_curve_walks_cell_by_cell(spark):
    cells = spark.range(512).select(*[F.shiftright("id", 3 * k).bitwiseAND(F.lit(7)).cast("int").alias(f"x{k}") for k in range(3)])
    order = cells.withColumn("h", sharding.hilbert([F.col(f"x{k}") for k in range(3)], 3)).orderBy("h").collect()
    assert [r["h"] for r in order] == list(range(512))
    assert all(sum(abs(a[k] - b[k]) for k in range(3)) == 1 for a, b in zip(order, order[1:]))


def test_sharding(spark, docs, tmp_path):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for i, (frame, shards) in enumerate(((sf, 8), (docs, 3), (empty(spark), 8), (sf.limit(3), 8))):
        sharding.write_shards(frame, str(tmp_path / str(i)))
        rows = sharding.read_shards(spark, str(tmp_path / str(i)), shards)
        n = rows.count()
        assert n == frame.count()
        assert sorted(str(r["doc_id"]) for r in rows.select("doc_id").collect()) == sorted(str(r["doc_id"]) for r in frame.select("doc_id").collect())
        got = rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect()
        assert all(r["a"] == 0 and r["b"] == r["n"] - 1 and r["d"] == r["n"] and abs(r["n"] * shards - n) < shards for r in got)


def test_shard_files_follow_the_curve_by_bytes(spark, tmp_path):
    """Files are runs of the curve of about equal bytes, though a few rows hold most of them, one cell a third, and a column thousands of values."""
    long = F.when(F.col("id") % 50 == 0, F.repeat(F.lit("x"), F.lit(20000))).otherwise(F.repeat(F.lit("y"), (F.col("id") % 300 + 1).cast("int")))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), long.alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("value "), F.col("id"))).alias("source"), (F.pmod(F.xxhash64("id"), F.lit(6000)) - 3000).alias("n"))
    path = str(tmp_path / "s")
    sharding.write_shards(docs, path, dimensions=("source", "n"), files=16)
    rows = sharding.read_shards(spark, path, 8)
    runs = sorted(rows.groupBy("file").agg(F.min("curve").alias("a"), F.max("curve").alias("b"), F.sum(F.length("text") + 1).alias("size")).collect(), key=lambda r: r["file"])
    assert len(runs) == 16 and all(x["b"] <= y["a"] for x, y in zip(runs, runs[1:]))
    mean = sum(r["size"] for r in runs) / 16
    assert max(r["size"] for r in runs) < 1.4 * mean
    assert rows.select("curve").distinct().count() > 300  # both columns are parted beyond a thousand values, negative numbers too
    order = [(r["shard"], r["slot"], r["curve"]) for r in rows.orderBy("shard", "slot").collect()]
    assert [c for _, _, c in order] == sorted(c for _, _, c in order)


def test_sharding_query_digests(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op7_hilbert_sharding(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {i: (len(t) + 1, zlib.crc32(t), "rows", None) for i, t in texts.items()}
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(8) for k in range(len(texts) // 8)]


VEC = "vec_id long, embedding array<float>, label int"
ODD = [(1000, None, 1), (1001, [], 1), (1002, [1.0, None], 1), (1003, [float("nan"), 1.0], 1), (1004, [0.0] * 4, 1), (1005, [1.0, 0.0, 0.0, 0.0], None), (1006, [float("inf")] * 4, 1), (1100, [1.0, 2.0], 1)]


def test_mtree_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m = np.round(rng.standard_normal((700, 4)), 1).astype("float32")  # many ties
    m[600:] = m[0]
    rows = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(m)] + ODD, VEC)
    got = mtree.top_k(rows, is_query=F.col("vec_id") % 100 == 0, page_rows=64, leaf=8, query_block=2).collect()
    q = np.floor(1024 * m.astype("float64")).astype("int64")
    four = {tuple(r) for r in got if r["query_id"] < 1000}
    extra = [(1005, np.array([1024, 0, 0, 0])), (1004, np.zeros(4, "int64"))]
    want = set()
    for i in range(0, 700, 100):
        others = sorted([(-int(q[j] @ q[i]), j) for j in range(700) if j != i] + [(-int(v @ q[i]), j) for j, v in extra])[:10]
        want |= {(i, k + 1, j, -v) for k, (v, j) in enumerate(others)}
    assert four == want
    assert mtree.top_k(rows.limit(0), is_query=F.lit(True)).count() == 0


def brute_top(m, ids, own, k):
    """The k best of whole-number vectors for each query id, in Python's numbers."""
    rows = [[int(x) for x in v] for v in m]
    want = set()
    for i in own:
        q = rows[ids.index(i)]
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in zip(ids, rows) if j != i)[:k]
        want |= {(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores)}
    return want


@pytest.mark.parametrize(("dim", "scale"), [(768, 1024.0), (1536, 1024.0), (5, 2.0**40), (3, 2.0**70)])
def test_mtree_in_many_dimensions_and_with_large_components(spark, dim, scale):
    """Many small pages, directory blocks and query blocks; scores beyond 2**53 are whole numbers held to a long."""
    rng = np.random.default_rng(dim)
    m = rng.standard_normal((400, dim))
    m[200:] = m[rng.integers(0, 40, 200)] + 0.05 * rng.standard_normal((200, dim))
    rows = spark.createDataFrame([(i, [float(x) for x in v], "clash") for i, v in enumerate(m)], "vec_id long, embedding array<double>, rank string")
    got = mtree.top_k(rows, is_query=F.col("vec_id") % 40 == 0, k=6, scale=scale, page_rows=24, root_cells=5, directory_pages=3, query_block=3, salt_blocks=1, leaf=4).collect()
    assert {tuple(r) for r in got} == brute_top(np.floor(scale * m), list(range(400)), range(0, 400, 40), 6)


def test_mtree_opens_few_leaves(spark):
    """Clustered vectors: most inner products of a page are never computed."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16)) * 1000
    m = np.floor(centres[rng.integers(0, 40, 4000)] + 10 * rng.standard_normal((4000, 16)))
    stored = mtree.Page.stored(np.arange(4000), m, 64)
    page = mtree.Page({"page": "x"} | stored)
    opened = []
    page.vectors = type("Counted", (), {"__getitem__": lambda _, rows, v=page.vectors: opened.append(len(rows)) or v[rows]})()
    q, ids, scores = page.search(m[:1], np.array([0]), np.array([-np.inf]), 10)
    all_scores = (m @ m[0]).astype("int64")
    order = [i for i in np.lexsort((np.arange(4000), -all_scores)) if i][:10]
    assert ids.tolist() == order and scores.tolist() == all_scores[order].tolist() and sum(opened) < 1500


def test_mtree_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.5]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [3.0]), (None, [9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in mtree.top_k(frame, is_query=F.col("vec_id") == 0, scale=2.0).collect())
    assert got == [(0, 1, 2, 6)]  # the query of fewest components
    got = sorted(tuple(r) for r in mtree.top_k(frame, is_query=F.col("vec_id") == 1, scale=2.0).collect())
    assert got == [(1, 1, 0, 8), (1, 2, 0, 4)]


def test_near_duplicate_embeddings(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((300, 16))
    m[100:200] = m[0] + 0.12 * rng.standard_normal((100, 16))
    m[200:230] = m[1]
    label = [i % 2 if i < 100 else 0 for i in range(300)]
    rows = spark.createDataFrame([(i, [float(x) for x in v], label[i]) for i, v in enumerate(m.astype("float32"))] + ODD, VEC)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nndescent.near_duplicates(rows, group_rows=48, block_rows=20).collect()}
    v = m.astype("float32").astype("float64")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    true, found = near.sum(), sum(got[i][0] for i in range(300))
    assert 0.95 * true <= found <= true and all(got[i][0] <= near[i].sum() for i in range(300))
    assert all(got[r[0]] == (0, r[0], True) for r in ODD)
    assert nndescent.near_duplicates(rows.limit(0)).count() == 0


def links_of(rows):
    v = np.array([r[1] for r in rows], "float32").astype("float64")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    return near


def check_embeddings(spark, rows, **arguments):
    """n_links and component_id against brute force, all rows."""
    near = links_of(rows)
    least = np.arange(len(rows))
    while True:
        new = np.minimum(least, np.where(near, least[None], len(rows)).min(axis=1))
        if (new == least).all():
            break
        least = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(spark.createDataFrame(rows, VEC), **arguments).collect()}
    wrong = [i for i in range(len(rows)) if got[i] != (near[i].sum(), least[i])]
    assert not wrong, (len(wrong), len(rows))


def test_neighbouring_dense_groups_link(spark):
    rng = np.random.default_rng(11)
    one = rng.standard_normal(32)
    one /= np.linalg.norm(one)
    side = rng.standard_normal(32)
    side -= (side @ one) * one
    side /= np.linalg.norm(side)
    other = np.cos(0.41) * one + np.sin(0.41) * side  # 23.5 degrees apart; 0.93 is 21.6
    m = np.concatenate([c + 0.012 * rng.standard_normal((300, 32)) for c in (one, other)])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m.astype("float32"))]
    near = links_of(rows)
    assert 0 < near[:300, 300:].sum() < 9000
    check_embeddings(spark, rows)


def pairs_fixture(hot):
    """Rows of 400 pairs at cosines of 0.935 to 0.95, 700 single vectors, and `hot` near copies of one vector."""
    rng = np.random.default_rng(12)
    m = rng.standard_normal((1500, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    side = rng.standard_normal((400, 32))
    side -= (side * m[:400]).sum(axis=1, keepdims=True) * m[:400]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.935, 0.95, (400, 1))
    m[400:800] = c * m[:400] + np.sqrt(1 - c * c) * side
    copies = rng.standard_normal(32) + 0.01 * rng.standard_normal((hot, 32))
    return [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([m, copies]).astype("float32"))]


def test_missed_audit_is_followed_by_exact_comparison(spark):
    check_embeddings(spark, pairs_fixture(0), tables=1, max_rounds=1, bucket_rows=8, min_recall=1.0)


def test_hot_group_does_not_hide_missed_pairs(spark):
    rows = pairs_fixture(500)
    got = {r["vec_id"]: r["n_links"] for r in nndescent.near_duplicates(spark.createDataFrame(rows, VEC), tables=1, bucket_rows=8).collect()}
    near = links_of(rows)
    assert sum(got[i] == near[i].sum() for i in range(800)) >= 0.9 * 800
    assert all(got[i] == near[i].sum() for i in range(1500, 2000))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (5, 5)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[150] == got[200] == 100


def test_pipeline_rejects_what_is_in_no_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = ["Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес", "これは日本語の文章です。今日は天気がいいですね", "xqzj wvkk qpzx zzgh jxqw vvkq xjzq pqwk", "1 2 3"]
    odd = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(texts)], DOC).select(*docs.columns)
    rows = docs.unionByName(odd)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, rows, "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, start, sf)
        assert out.columns == docs.columns, name
        start = spark.createDataFrame(out.toPandas(), docs.schema)
    assert 0 < start.count() < docs.count()
    left = {r["component_id"] for r in jaccard.jaccard_classes(start).collect()}
    assert len(left) == start.count()
    mixed = corpus_pipeline.mixture(spark, start, sf)
    pieces = corpus_pipeline.windows(spark, mixed, sf)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(x) + 1 for x in plain(BYTE, [r["text"] or "" for r in mixed.collect()]))


STAGE_TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away into the dark wood near the old river bank",
    "The quick brown fox jumps over the lazy dog and runs away into the dark wood near the old river bank today",
    "Ein anderer Text mit vielen Wörtern, der von einem Hund handelt, welcher durch den Wald läuft und bellt",
    "", None, "   ", "12 34", "word " * 30_000,
]
CLASH = {"n_removed": "a", "n_lines": "b", "copy": "c", "shuffle_key": "d", "pipeline_lang": "e", "pipeline_fit": "f", "own_copy": "g", "component_id": "h", "n_shingles": "i", "dedup_kept": "j", "mix_count": "k"}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_edge_cases(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(i, t, ("en", "de")[i == 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(STAGE_TEXTS)] + [(None, STAGE_TEXTS[2], None, None, 5), (0, STAGE_TEXTS[0], "en", "s0", 100)]
    plain = spark.createDataFrame(rows, DOC)
    docs = plain.withColumns({k: F.concat(F.lit(v), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for k, v in CLASH.items()})
    out = stage(spark, docs, "")
    got = out.collect()
    assert stage(spark, docs.limit(0), "").count() == 0
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}
        return
    assert out.schema.names == docs.schema.names
    for r in got:
        assert all(r[k] == v + (str(r["doc_id"]) if r["doc_id"] is not None else "-") for k, v in CLASH.items())
    ids = [r["doc_id"] for r in got]
    if name == "language":
        assert not {3, 4, 5, 6} & set(ids)
    elif name == "lines":
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows) and {r["text"] for r in got} == {r[1] for r in rows}
    elif name == "near_duplicates":
        assert 1 not in ids and ids.count(0) == 2 and {3, 4, 5, None} <= set(ids)
    else:
        assert set(ids) <= {r[0] for r in rows}
        plain_ids = sorted(str(r["doc_id"]) for r in stage(spark, plain, "").collect())
        assert sorted(map(str, ids)) == plain_ids
