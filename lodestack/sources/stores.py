"""Reading what is stored: documents by time, path and page, workflow files, and vectors from a provider."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.predicates import matches_any_glob

#: Texts of one call to a provider, and rows of a page.
CALL, PAGE = 10, 1000


def documents(notes: DataFrame, *, exclude: Sequence[str] = (), since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Notes (path, mtime, ...) without the excluded paths, changed after `since`, the first `limit` by path."""
    rows = notes.filter(~matches_any_glob(F.col("path"), exclude)) if exclude else notes
    rows = rows.filter(F.col("mtime") > since) if since is not None else rows
    return rows if limit is None else rows.orderBy("path").limit(limit)


def document(notes: DataFrame, path: str) -> DataFrame:
    return notes.filter(F.col("path") == path)


def exists(notes: DataFrame, path: str) -> bool:
    return not document(notes, path).isEmpty()


def page(notes: DataFrame, after: int | None = None, size: int = PAGE, key: str = "id") -> DataFrame:
    """The next rows by key: a later page costs no more than the first, since nothing is counted off."""
    rows = notes if after is None else notes.filter(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def below(notes: DataFrame, prefix: str) -> DataFrame:
    """Notes whose path starts with the prefix, as it is written: no character stands for others."""
    return notes.filter(F.col("path").startswith(prefix))


def workflow_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, text) of the .yaml files of a folder, not those below it, by name. They configure the driver, and are few."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder).select("path", F.decode("content", "UTF-8").alias("text")).collect()
    return sorted((r["path"].rpartition("/")[2], r["text"]) for r in rows)


def embedded(text: str, provider: Callable[[list[str]], Sequence[Sequence[float]]], *, call: int = CALL, tries: int = 3, wait: float = 0.5) -> Column:
    """The provider's vectors of a text column, ten texts a call; a call that fails is tried again, and then fails the task. Null for null."""

    def ask(texts: list[str]) -> list:
        for turn in range(tries):
            try:
                found = list(provider(texts))
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                return found
            except Exception:
                if turn == tries - 1:
                    raise
                time.sleep(wait * 2**turn)
        return []

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(at), call):
                part = at[k : k + call]
                for i, v in zip(part, ask([texts.iloc[i] for i in part]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, index=texts.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)
