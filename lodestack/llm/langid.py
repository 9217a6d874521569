"""Operator 10, language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased by character, each run of other characters than letters becomes one space, as do both ends, and n-grams
of the given sizes are hashed to a fixed number of buckets. Training counts (label, bucket) pairs in the tasks and adds
them up by aggregation; the matrix of log-probabilities (labels x buckets, whose size is fixed by the parameters and
checked) is broadcast. Scoring gathers the matrix rows of a batch's n-grams and adds them up by document in numpy.

`fit` tells whether a text is in its label's language at all: by how many spreads the mean log-probability of its n-grams lies
over the one usual in that label's texts. Other labels have no part in it, so a text in a language not learned has a low one.

The training sample is bounded by `max_docs_per_label`, a hash of the id decides; all its texts are used whole.

Cases: a null text, an empty one and one without letters give `und` and score 0; rows without a label train
nothing; without any training row all predictions are `und`; ties go to the label that sorts first; repeated rows get
equal predictions; other columns pass through, but for earlier ones named as the outputs, which are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import by_bytes

UND = "und"


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels, float32 log-probabilities
    prior: np.ndarray
    sizes: tuple[int, ...]

    def usual(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and spread of an n-gram's log-probability in texts of each label."""
        logs = self.table.astype("float64")
        share = np.exp(logs)
        mean = (share * logs).sum(axis=0)
        return mean, np.sqrt((share * (logs - mean) ** 2).sum(axis=0))


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for what is no letter; index 0x10FFFF stands for the rest of the planes."""
    out = np.zeros(0x110000, "uint32")
    for c in range(0x20000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low[0])
    out[0x20000:0x323B0] = np.arange(0x20000, 0x323B0, dtype="uint32")  # ideographs
    return out


def ngrams(text: pa.Array, sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: bucket of every n-gram, and the row each belongs to (ascending)."""
    texts = [f" {t or ''} " for t in text.to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), "int64", len(texts))
    mapped = _letters()[points]
    row = np.repeat(np.arange(len(texts), dtype="int32"), lengths)
    keep = mapped != 0
    keep[:1] = True
    keep[1:] |= (mapped[:-1] != 0) | (row[1:] != row[:-1])
    mapped, row = mapped[keep], row[keep]
    for n in sizes:
        if len(mapped) < n:
            continue
        last = len(mapped) - n + 1
        value = np.full(last, 0x9E3779B9 * n & 0xFFFFFFFF, "uint32")
        solid = np.zeros(last, bool)
        for k in range(n):
            value = (value ^ mapped[k : k + last]) * np.uint32(0x85EBCA6B)
            value ^= value >> np.uint32(15)
            solid |= mapped[k : k + last] != 0
        solid &= row[:last] == row[n - 1 :]
        yield (value[solid] & np.uint32(buckets - 1)).astype("int32"), row[:last][solid]


def train(
    docs: DataFrame,
    *,
    label_column: str = "lang",
    text_column: str = "text",
    id_column: str = "doc_id",
    sizes: tuple[int, ...] = (2, 3),
    buckets: int = 1 << 16,
    smoothing: float = 0.1,
    max_docs_per_label: int = 4000,
    max_model_bytes: int = 256 << 20,
) -> Model:
    """Fit on the rows with a label and a text, at most about `max_docs_per_label` of each label."""
    labelled = docs.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(label_column).cast("string").alias("label"), F.col(text_column).alias("text")
    )
    counts = sorted((r["label"], r["n"]) for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect())
    labels = [x for x, _ in counts]
    if len(labels) * buckets * 4 > max_model_bytes:
        raise ValueError(f"{len(labels)} labels x {buckets} buckets exceed max_model_bytes; lower buckets")
    total = sum(n for _, n in counts) or 1
    prior = np.log(np.array([n / total for _, n in counts] or [1.0]))
    share = F.lit(0.0)
    for label, n in counts:
        share = F.when(F.col("label") == label, F.lit(min(1.0, max_docs_per_label / n))).otherwise(share)
    spot = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("train")), F.lit(1_000_000))
    sample = labelled.filter(spot < share * 1_000_000)
    code = {label: i for i, label in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(labels), buckets), "int64")
        for batch in by_bytes(batches, "text", 1 << 19):
            owner = np.array([code[x] for x in batch.column("label").to_pylist()], "int64")
            for bucket, row in ngrams(batch.column("text"), sizes, buckets):
                seen += np.bincount(owner[row] * buckets + bucket, minlength=seen.size).reshape(seen.shape)
        label, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.astype("int32")), pa.array(bucket.astype("int32")), pa.array(seen[label, bucket])], names=["label", "bucket", "n"]
        )

    added = sample.select("label", "text").mapInArrow(run, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    got = added.toArrow()  # at most labels x buckets rows
    n = np.full((buckets, max(1, len(labels))), smoothing)
    n[got["bucket"].to_numpy(), got["label"].to_numpy()] += got["n"].to_numpy()
    return Model(labels, np.log(n / n.sum(axis=0)).astype("float32"), prior, sizes)


def score(text: pa.Array, model: Model, evidence: float = 60.0) -> tuple[list[str], np.ndarray]:
    """Label and score of each text. The posterior takes a text's mean evidence as if it had `evidence` n-grams at most, so that it stays comparable between short and long texts."""
    n, buckets = len(text), len(model.table)
    sums, seen = np.zeros((n, len(model.prior))), np.zeros(n, "int64")
    for bucket, row in ngrams(text, model.sizes, buckets):
        if not len(row):
            continue
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        gathered = model.table[bucket]
        sums[row[starts]] += np.add.reduceat(gathered, starts, axis=0, dtype="float64")
        seen[row[starts]] += np.diff(np.append(starts, len(row)))
    scale = np.minimum(1.0, evidence / np.maximum(seen, 1))
    logit = sums * scale[:, None] + model.prior
    logit -= logit.max(axis=1, keepdims=True)
    odds = np.exp(logit)
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)
    known = (seen > 0) & bool(model.labels)
    labels = [model.labels[b] if k else UND for b, k in zip(best, known, strict=True)]
    return labels, np.where(known, odds[np.arange(n), best], 0.0)


def fit(text: pa.Array, model: Model, labels: list[str], usual: tuple[np.ndarray, np.ndarray], errors: float = 3.0) -> np.ndarray:
    """Fit of each text to its label, `errors` standard errors of so short a text in its favour; 0 for `und`."""
    n, code = len(text), {label: i for i, label in enumerate(model.labels)}
    own = np.array([code.get(x, 0) for x in labels], "int64")
    sums, seen = np.zeros(n), np.zeros(n)
    for bucket, row in ngrams(text, model.sizes, len(model.table)):
        sums += np.bincount(row, model.table[bucket, own[row]], n)
        seen += np.bincount(row, minlength=n)
    mean, spread = usual
    seen1 = np.maximum(seen, 1)
    out = (sums / seen1 - mean[own]) / np.maximum(spread[own], 1e-9) + errors / np.sqrt(seen1)
    return np.where([x in code for x in labels], out, 0.0)


def predict(docs: DataFrame, model: Model, *, text_column: str = "text", label_out: str = "lang_pred", score_out: str = "score", fit_out: str | None = None) -> DataFrame:
    """All rows and columns, with the predicted label and its score, and its fit if asked for; of the columns only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(label_out, score_out, *([fit_out] if fit_out else []))
    usual = model.usual() if fit_out else None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_column, 1 << 19):
            labels, scores = score(batch.column(text_column), shared.value)
            out = {label_out: pa.array(labels, pa.string()), score_out: pa.array(scores)}
            if fit_out:
                out[fit_out] = pa.array(fit(batch.column(text_column), shared.value, labels, usual))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out.values()], names=[*batch.schema.names, *out])

    return docs.mapInArrow(run, f"{fields}, `{label_out}` string, `{score_out}` double" + (f", `{fit_out}` double" if fit_out else ""))


def held_out(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2
