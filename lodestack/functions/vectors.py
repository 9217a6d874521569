"""Vector arithmetic as columns, and scorers made of it."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """The vector at length 1; one of length 0 stays as it is."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def mean_pool(tokens: Column | str, mask: Column | str) -> Column:
    """The mean of the token vectors whose mask isn't 0; null where none is."""
    pairs = F.filter(F.arrays_zip(F.col(tokens).alias("v") if isinstance(tokens, str) else tokens.alias("v"), F.col(mask).alias("m") if isinstance(mask, str) else mask.alias("m")), lambda p: p["m"] != 0)
    first = F.transform(F.element_at(tokens, 1), lambda x: x.cast("double") * 0)
    total = F.aggregate(pairs, first, lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b.cast("double")))
    return F.when(F.size(pairs) > 0, F.transform(total, lambda x: x / F.size(pairs)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def by_norm(embed: Callable[[list[str]], Sequence[Sequence[float]]], form: str = "{query}\n{text}") -> Callable[[str, list[str]], list[float]]:
    """A reranker: the shorter the vector of query and text together, the better."""
    return lambda query, texts: [-math.sqrt(sum(x * x for x in v)) for v in embed([form.format(query=query, text=t) for t in texts])]


def by_pair(logits: Callable[[str, list[str]], Sequence[float]]) -> Callable[[str, list[str]], list[float]]:
    """A reranker of a model that reads query and text together: the sigmoid of its logits."""
    return lambda query, texts: [1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, x)))) for x in logits(query, texts)]
