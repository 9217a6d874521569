"""Reading vectors in Arrow batches, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid(vector: str, kind: T.DataType) -> F.Column:
    """No null, no null component, none that isn't finite, and one component at least."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each number of dimensions in the batch."""
    lists = batch.column(column)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, values[starts[rows][:, None] + np.arange(dim)]


def stacked(blobs: pa.Array, kind: str) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), -1)


def whole(rows: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow whose function maps one batch to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return rows.mapInArrow(run, schema)
