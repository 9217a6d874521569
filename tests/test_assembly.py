import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import assembly, records


def nested(rng, low, high, depth, out):
    """Bands that are nested or apart, between low and high."""
    at = low
    while at < high and depth < 6:
        a = rng.randrange(at, high + 1)
        b = rng.randrange(a, high + 1)
        out.append((a, b))
        if rng.random() < 0.2:
            out.append((a, b))
        nested(rng, a, b - 1, depth + 1, out)
        at = b + 1


def test_innermost_band_by_a_sweep(spark):
    rng, bands, points = random.Random(7), [], []
    for key in range(12):
        own = []
        nested(rng, 0, 60, 0, own)
        bands += [(key, i, a, b) for i, (a, b) in enumerate(own)]
        points += [(key, p, "x") for p in range(-2, 64)] + [(key, 30, "again")]
    points += [(99, 5, "no bands"), (None, 5, "no key"), (3, None, "no place")]
    want = sorted(((k, p, x, min(((b - a, i) for key, i, a, b in bands if key == k and p is not None and a <= p <= b), default=(0, None))[1]) for k, p, x in points), key=str)
    got = assembly.innermost(spark.createDataFrame(points, "k long, p long, note string"), spark.createDataFrame(bands, "k long, name long, low long, high long"), "k", "p", "low", "high", "name")
    assert got.columns == ["k", "p", "note", "name"] and sorted(map(tuple, got.collect()), key=str) == want


def test_a_note_of_many_sections(spark):
    n = 20_000
    bands = spark.range(n).select(F.lit("note").alias("k"), F.col("id").alias("name"), F.col("id").alias("low"), (3 * n - F.col("id")).alias("high"))
    points = spark.range(0, 3 * n, 7).select(F.lit("note").alias("k"), F.col("id").alias("p"))
    got = assembly.innermost(points, bands, "k", "p", "low", "high", "name")
    assert got.filter(F.coalesce("name", F.lit(-1)) != F.least(F.col("p"), F.lit(n - 1), 3 * n - F.col("p"))).count() == 0 and got.count() == points.count()


def test_previews_of_imports(spark):
    rows = spark.createDataFrame([("p", "1", "a", "user", "x", None, 0)], "provider string, external_id string, id string, role string, text string, at string, pos int")
    row = records.previews(rows, "store://v/chats/").first()
    assert row["source_id"].startswith("conversation:") and row["hash"].startswith("sha256:") and row["target"] == f"store://v/chats/conversation-{row['source_id'][13:]}.md"
    for wrong in ("store://v/chats", "chats/", "store://v/../x/"):
        with pytest.raises(ValueError):
            records.previews(rows, wrong)


def test_a_sweep_carries_no_column_twice(spark):
    bands = spark.createDataFrame([(1, 0, 9, 1), (1, 2, 4, 2)], "k long, low long, high long, name int")
    points = spark.createDataFrame([(1, 3, "a"), (1, 9, "b"), (1, 10, "c"), (2, 3, "d"), (1, None, "e")], "k int, p int, note string")
    found = assembly.innermost(points, bands, "k", "p", "low", "high", "name")
    assert found.schema.simpleString() == "struct<k:int,p:int,note:string,name:int>"
    assert {r["note"]: r["name"] for r in found.collect()} == {"a": 2, "b": 1, "c": None, "d": None, "e": None}
    bare = assembly.innermost(points.drop("note"), bands, "k", "p", "low", "high", "name")
    assert "own" not in bare._jdf.queryExecution().optimizedPlan().toString()
