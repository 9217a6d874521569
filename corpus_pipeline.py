"""A corpus pipeline of five stages over `documents`: language, boilerplate lines, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; `run` writes each result as Parquet
in the shared folder and reads it again as the next one's docs. All stages but the last return the columns of docs; columns that
docs has besides come through with their values, whatever their names. Each stage's docstring tells what null and empty texts give; an
empty table gives an empty table, very long texts are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import jaccard, langid, linededup, mixing, packing
from lodestack.llm.common import scratch
from lodestack.runtime import drop, ship, table


#: On sf0.1 the least fit of a text is near -2 spreads; invented Russian, Japanese and random letters are below -5.
LEAST_FIT = -2.5


def beside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with its own columns of these names, which an operator will use, under other names, and the columns to select them back."""
    own = {}
    for name in docs.columns:
        if name.lower() in names:
            own[name] = f"own_{name}"
            while own[name] in docs.columns or own[name] in list(own.values())[:-1]:
                own[name] += "_"
    return docs.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is one of those learned from the labelled rows.

    Texts without letters go, and those whose n-grams are too improbable in their best language, such as texts in a language
    not learned or garbled ones. Rows without a label are judged like all others.
    """
    model = langid.train(docs)
    rows, back = beside(docs, "pipeline_lang", "pipeline_score", "pipeline_fit")
    judged = langid.predict(rows, model, label_out="pipeline_lang", score_out="pipeline_score", fit_out="pipeline_fit")
    return judged.filter((F.col("pipeline_lang") != langid.UND) & (F.col("pipeline_fit") >= LEAST_FIT)).select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out the lines that stand on five sources or more, if a quarter of the documents that have them are of different kinds.

    So a document that many sources copy keeps its lines, and the copies stay alike for the next stage. All rows stay: a null
    text stays null, an empty one empty, one whose lines all go becomes empty; a null source is a source of its own.
    """
    rows, back = beside(docs, "n_lines", "n_removed", "dedup_kept", "dedup_gone", "dedup_lookup", "dedup_key")
    kept = linededup.line_dedup(rows, min_sites=5, spread=0.25)
    # n_chars follows the text, where the text changed.
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of Jaccard similarity 0.75 or more connect, the one of the smallest id stays.

    Texts without words link with nothing and stay, as do rows without an id. Rows that repeat that id stay with it.
    """
    classes = jaccard.jaccard_classes(docs, words=5, threshold=0.75)
    copies = classes.filter((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw each source to the square root of its bytes, about as many bytes as there are, in global random order.

    Rows may go or repeat, as drawn; a null source is a source of its own, one without bytes is kept once, and rows of one id
    (null ids count as one) draw the same count.
    """
    rows, back = beside(docs, "copy", "shuffle_key", "mix_source", "mix_draws", "mix_steps", "mix_count")
    return mixing.mix(rows, temperature=0.5, epochs=1.0, seed="pipeline").select(*back)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all drawn documents into sequences of 1024 ids; null and empty texts are an end id, repeated rows are packed each."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", windows),
]

#: The first, third and last stage can't be told in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes as soon as the next one is written; the last stays until `drop_scratch`."""
    docs, before = table(ship(spark), sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
