"""Operator 4, token output: ORC files with run-length encoded ids, row indexes and Bloom filters on document ids.

Documents are dealt to files by ranges of their id and sorted within, so file f holds smaller ids than file f + 1, and
stripe statistics and Bloom filters skip what a lookup doesn't need. Each row holds the position of its first id
within its file; a file's position in the whole store follows from one sum a file, read from the small column alone.

Cases: a null text is empty; an empty text has the end id alone; rows with equal ids are ordered by text and stay in one
file; null ids come first; an empty table gives an empty store; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.common import by_bytes, partitions
from lodestack.llm.tokens import load


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 2,
    files: int | None = None,
    stripe_bytes: int = 64 << 20,
    row_index_stride: int = 10_000,
    bloom_fpp: float = 0.01,
    compression: str = "zstd",
) -> None:
    """Encode every whole text, append `end_id`, and write (id, shard, shard_start, n_tokens, ids) in ascending id order."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, at = load(tokenizer), TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, text_column):
            ids, offsets = encoder.encode(batch.column(text_column))
            ids = np.insert(ids, offsets[1:], end_id).astype("int32")
            offsets = offsets + np.arange(len(offsets))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_column),
                    pa.array(np.full(batch.num_rows, shard, "int32")),
                    pa.array(at + offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(ids)),
                ],
                names=[id_column, "shard", "shard_start", "n_tokens", "ids"],
            )
            at += int(offsets[-1])

    rows = docs.select(id_column, text_column)
    ordered = rows.repartitionByRange(files or partitions(docs.sparkSession), id_column).sortWithinPartitions(id_column, text_column)
    tokens = ordered.mapInArrow(run, f"`{id_column}` {kind}, shard int, shard_start long, n_tokens long, ids array<int>")
    (
        tokens.write.option("orc.compress", compression)
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.bloom.filter.columns", id_column)
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows with `start`, the number of ids of all documents before; the id column's filters reach the files."""
    rows = spark.read.orc(path)
    # One row a file: the window's single task reads as many rows as there are files, whatever the files hold.
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = F.sum("shard_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def digest_tokens(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row of `read_tokens`: id, start, the number of ids read and their crc32 as little-endian uint32."""
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), batch.column("start"), pa.array(np.diff(offsets).astype("int64")), pa.array(crc, pa.int64())],
                names=[id_column, "start", "n_tokens", "ids_crc32"],
            )

    return rows.select(id_column, "start", "ids").mapInArrow(run, f"`{id_column}` {kind}, start long, n_tokens long, ids_crc32 long")
