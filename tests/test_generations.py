import pytest
from pyspark.sql import functions as F

from lodestack.operators.generations import Generations


def test_a_generation_is_used_when_it_is_complete(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "g"))
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "chunk long, text string")
    embed = lambda dim: lambda rows: rows.select("chunk", F.array_repeat(F.lit(float(dim)), dim).alias("vector"))
    assert store.active is None and store.vectors().count() == 0 and store.inventory(chunks).count() == 0
    store.register("a", 2)
    store.register("a", 2)
    with pytest.raises(ValueError, match="dimensions"):
        store.register("a", 3)
    with pytest.raises(ValueError, match="registered"):
        store.fill(chunks, "b", embed(2))
    assert store.switch(chunks, "b") == {"ok": False, "reason": "unknown_model"}
    assert store.fill(chunks.filter("chunk < 5"), "a", embed(2)) == 5
    assert store.switch(chunks, "a") == {"ok": False, "reason": "incomplete", "missing_chunks": 15}
    seen = []

    def counted(rows):
        seen.append(rows.count())
        if len(seen) == 2:
            raise RuntimeError("stopped")
        return embed(2)(rows)

    with pytest.raises(RuntimeError):
        store.fill(chunks, "a", counted, parts=3)  # the first part stays
    assert store.fill(chunks, "a", counted, parts=3) == 15 - seen[0] and sum(seen[2:]) == 15 - seen[0] and store.fill(chunks, "a", embed(2)) == 0
    assert store.switch(chunks, "a") == {"ok": True, "switched_from": None, "switched_to": "a"} and store.switch(chunks, "a")["reason"] == "already_active"

    # A second generation of other vectors is seen only after the switch.
    store.register("b", 3)
    with pytest.raises(ValueError, match="vectors"):
        store.fill(chunks, "b", embed(2))
    assert store.fill(chunks, "b", embed(3), parts=2) == 20 and {len(r["vector"]) for r in store.vectors().collect()} == {2}
    assert store.switch(chunks, "b")["switched_from"] == "a" and {len(r["vector"]) for r in store.vectors().collect()} == {3} and store.vectors().count() == 20
    fewer = chunks.filter("chunk <> 7").unionByName(spark.createDataFrame([(77, "new")], "chunk long, text string"))
    assert [r["chunk"] for r in store.orphans(fewer, "b").collect()] == [7] and [r["chunk"] for r in store.missing(fewer, "b").collect()] == [77]
    told = {r["model"]: tuple(r) for r in store.inventory(fewer).collect()}
    assert told == {"a": ("a", 2, False, 20, 19, 1, False), "b": ("b", 3, True, 20, 19, 1, False)}
