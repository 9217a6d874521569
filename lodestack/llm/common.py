"""What the training-data operators share: the shared folder, checkpoints, and Arrow batch helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.runtime import scratch, shared_dir

__all__ = ["by_bytes", "components", "cut_lineage", "flat_text", "mix64", "partitions", "scratch", "shared_dir"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which survives lost executors. Spark removes it with its plan where
    spark.cleaner.referenceTracking.cleanCheckpoints is set; else it stays until the folder goes."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release() -> None:
    """Give memory that is free back to the system: a worker is used again by many tasks, and else keeps the most it ever had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of `column` each (one row at least), so memory stays bounded."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype="float64"))
        ends = np.cumsum(sizes)
        start, n = 0, batch.num_rows
        while start < n:
            floor = ends[start - 1] if start else 0.0
            end = max(start + 1, int(np.searchsorted(ends, floor + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
        del batch, text
        release()


def flat_text(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none) and the offsets of each, without copies where Arrow allows."""
    text = pc.fill_null(text, "")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    offs = np.frombuffer(offsets, dtype="int64")[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, dtype="uint8") if data is not None and data.size else np.zeros(0, "uint8")
    return raw[offs[0] : offs[-1]], offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, limit: int = 40) -> DataFrame:
    """Connected components of (a, b) links as rows (node, comp); comp is the smallest node that is reachable.

    Alternating large-star and small-star rounds: each is one aggregation and one join on narrow rows, the number
    of rounds is logarithmic, and lineage is cut in the shared folder every round. Only a count reaches the driver.
    """
    now = cut_lineage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(limit):
        if now.isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.filter("a <> b").distinct()
        root = small.groupBy("a").agg(F.min("b").alias("m"))
        moved = small.join(root, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        now = cut_lineage(moved.filter("a <> b").distinct())
        sign = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first()
        if before == sign and sign[0] == sign[2]:
            break
        before = sign
    else:
        raise RuntimeError(f"no fixed point after {limit} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )
