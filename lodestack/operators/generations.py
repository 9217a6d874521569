"""Vectors by generation: a model's vectors are filled in beside those in use, and searches switch to them only when none is missing.

A generation is a model with its dimension. What is filled is written in parts, each counted by the manifest when it is whole, so an
interrupted fill goes on where it stopped, and a search reads the vectors of one generation only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.manifest import Manifest


class Generations:
    def __init__(self, spark: SparkSession, path: str, key: str = "bigint"):
        self.spark, self.path, self.kind, self.manifest = spark, path, f"chunk {key}, vector array<double>", Manifest(spark, path)

    def _content(self) -> tuple[int, dict[str, Any]]:
        version, content = self.manifest.read()
        return version, {"models": {}, "active": None} | content

    @property
    def active(self) -> str | None:
        return self._content()[1]["active"]

    def register(self, model: str, dim: int, provider: str = "") -> None:
        """A new generation, which isn't in use; one that is there already must have the same dimension."""
        version, content = self._content()
        known = content["models"].get(model)
        if known:
            if known["dim"] != dim:
                raise ValueError(f"{model} has {known['dim']} dimensions, not {dim}")
            return
        self.manifest.commit(version, content | {"models": content["models"] | {model: {"dim": dim, "provider": provider}}})

    def vectors(self, model: str | None = None) -> DataFrame:
        """chunk, vector of one generation, by default the one in use; none if there is none."""
        content = self._content()[1]
        name = content["active"] if model is None else model
        paths = [f"{self.path}/vectors/{s['id']}" for s in content["segments"] if s["model"] == name]
        return self.spark.read.schema(self.kind).parquet(*paths) if paths else self.spark.createDataFrame([], self.kind)

    def missing(self, chunks: DataFrame, model: str) -> DataFrame:
        """The chunks (chunk, ...) that the generation has no vector of."""
        return chunks.join(self.vectors(model).select("chunk"), "chunk", "left_anti")

    def orphans(self, chunks: DataFrame, model: str) -> DataFrame:
        """chunk: those with a vector that are no chunk any more."""
        return self.vectors(model).select("chunk").join(chunks.select("chunk"), "chunk", "left_anti")

    def fill(self, chunks: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame], parts: int = 1) -> int:
        """Embed what is missing, by `embed` (rows of chunks -> chunk, vector), in so many parts by a hash of the chunk; how many were embedded.

        A part is counted when all of it is written; a vector of another length, or a chunk without one, fails its part.
        """
        if model not in self._content()[1]["models"]:
            raise ValueError(f"{model} is no registered generation")
        done = 0
        for part in range(parts):
            todo = self.missing(chunks.filter(F.pmod(F.xxhash64("chunk"), F.lit(parts)) == part), model)
            segment = uuid.uuid4().hex
            place = f"{self.path}/vectors/{segment}"
            embed(todo).select("chunk", F.col("vector").cast("array<double>").alias("vector")).write.parquet(place)
            version, content = self._content()
            dim = content["models"][model]["dim"]
            n, fitting = self.spark.read.schema(self.kind).parquet(place).agg(F.count("*"), F.count_if(F.size("vector") == dim)).first()
            if n != fitting or n != todo.count():
                raise ValueError(f"{n} vectors, {fitting} of {dim} dimensions")
            if n:
                self.manifest.commit(version, content | {"segments": [*content["segments"], {"id": segment, "model": model, "n": n}]})
            done += n
        return done

    def switch(self, chunks: DataFrame, model: str) -> dict[str, Any]:
        """Put a generation to use, if it's known, not yet in use, and complete: ok, and else the reason and how many chunks it misses."""
        version, content = self._content()
        if model not in content["models"]:
            return {"ok": False, "reason": "unknown_model"}
        if content["active"] == model:
            return {"ok": False, "reason": "already_active"}
        missing = self.missing(chunks, model).count()
        if missing:
            return {"ok": False, "reason": "incomplete", "missing_chunks": missing}
        self.manifest.commit(version, content | {"active": model})
        return {"ok": True, "switched_from": content["active"], "switched_to": model}

    def inventory(self, chunks: DataFrame) -> DataFrame:
        """model, dim, active, chunks, embedded, orphans, complete of each generation."""
        content = self._content()[1]
        there = chunks.select("chunk", F.lit(True).alias("there"))
        rows = []
        for name, model in sorted(content["models"].items()):
            both = there.join(self.vectors(name).select("chunk", F.lit(True).alias("held")), "chunk", "full")
            counts = both.agg(F.count("there").alias("chunks"), F.count_if(F.col("there") & F.col("held")).alias("embedded"), F.count_if(F.col("there").isNull()).alias("orphans"))
            rows.append(counts.select(F.lit(name).alias("model"), F.lit(model["dim"]).alias("dim"), F.lit(content["active"] == name).alias("active"), "*", (F.col("chunks") == F.col("embedded")).alias("complete")))
        empty = self.spark.createDataFrame([], "model string, dim int, active boolean, chunks bigint, embedded bigint, orphans bigint, complete boolean")
        return reduce(DataFrame.unionByName, rows) if rows else empty
