"""Operator 13, license scans: an exact set-similarity join of text blocks with license templates, in built-in expressions only.

Words are runs of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII. A text's blocks are windows of `width` words, one
every half of that; templates of more than half a window are cut into parts of that length, so wherever a part stands, one block
holds it whole. A block meets a part if it holds at least the share `threshold` of the part's distinct words (containment).

All blocks that meet a part are found, by filters that lose none:

- order: the templates' words are ordered by how many documents have them, rare ones first; a set keeps this order;
- prefix: a part of n words of which `need` must be found is met only by blocks that hold one of its first n - need + 1 words, so
  blocks without any such word are dropped where they stand, before a shuffle;
- length: a block must hold `need` of the templates' words;
- position: if the shared word stands at i in the part and at j in the block's ordered set, no more than 1 + min(n - i - 1, m - j - 1)
  words can be shared from there on, which must reach `need`; the first shared word of a pair that qualifies always does.

Pairs that pass are verified by the size of their intersection. The words of all parts' prefixes go to the tasks as one array as long as they are `max_lookup`
at most; beyond that, words and blocks are joined. Both ways give the same rows. Documents are read twice (for the frequencies, and for
the blocks), nothing of a text is shuffled but the ordered sets of candidate blocks.

Phrases (`base`) are looked for apart, word by word, in every text; a hit gives the phrase's label whatever the join says.

Cases: a null or empty text has no words and no label; a text shorter than a window is one block; very long texts are cut into blocks
like others; repeated rows and ids, and null ids, get a row each, as results are joined by id and text hash; a template met by several blocks counts once;
other columns are not read, whatever their names; an empty table gives no rows, empty templates give base labels only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import cut_lineage, scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labels and customary notices of well-known licenses. Notices that differ in a word or two stand once, by family.
TEMPLATES = [
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


def words(text: Column) -> Column:
    """All words of a text. Texts of ASCII only are lower-cased whole, others letter by letter, so that no other letter becomes an ASCII one."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def with_words(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """license_key (id and text hash) and ws; a generator between, so that a text is parted once and not again at each use."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    key = F.named_struct(F.lit("id"), F.col(id_column), F.lit("hash"), F.md5(text))
    return docs.select(key.alias("license_key"), F.explode(F.array(words(text))).alias("ws"))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(templates), "label string, text string")


def template_parts(templates: DataFrame, width: int, threshold: float) -> DataFrame:
    """part, label, token (distinct ones), size, need: templates (label, text) cut into parts of half a window at most."""
    half = width // 2
    each = templates.select("label", F.explode(F.array(words(F.coalesce("text", F.lit(""))))).alias("ws")).filter("label is not null and size(ws) > 0").distinct()
    # Parts of about equal length, so that no short rest becomes a part of its own.
    cuts = F.ceil(F.size("ws") / half).cast("int")
    size = F.ceil(F.size("ws") / cuts).cast("int")
    cut = each.select("label", "ws", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("k"), size.alias("n"))
    cut = cut.select("label", F.array_distinct(F.slice("ws", F.col("k") * F.col("n") + 1, F.col("n"))).alias("tokens")).filter("size(tokens) > 0").distinct()
    need = F.ceil(F.size("tokens") * threshold - 1e-9).cast("int")
    cut = cut.select(F.md5(F.concat_ws(" ", "label", F.array_join("tokens", " "))).alias("part"), "label", F.size("tokens").alias("size"), F.greatest(need, F.lit(1)).alias("need"), "tokens")
    return cut.select("part", "label", "size", "need", F.explode("tokens").alias("token"))


def ordered(parts: DataFrame, docs_words: DataFrame, max_lookup: int) -> tuple[DataFrame, DataFrame]:
    """The templates' words with their place in the global order (token, place), and the parts (part, label, size, need, places in order)."""
    vocabulary = cut_lineage(parts.select("token").distinct())
    few = vocabulary.count() <= max_lookup
    seen = docs_words.select(F.explode(F.array_distinct("ws")).alias("token"))
    frequency = seen.join(F.broadcast(vocabulary) if few else vocabulary, "token", "left_semi").groupBy("token").agg(F.count("*").alias("docs"))
    ranked = vocabulary.join(frequency, "token", "left").select("token", F.coalesce("docs", F.lit(0)).alias("docs"))
    # A place is the frequency and the word itself, so that no row number over all words is needed.
    place = F.struct("docs", "token")
    order = cut_lineage(ranked.select("token", place.alias("place")))
    sets = parts.join(order, "token").groupBy("part", "label", "size", "need").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return order, cut_lineage(sets)


def blocks_of(rows: DataFrame, rare: DataFrame, width: int, max_lookup: int) -> DataFrame:
    """rows with `blocks`: number and distinct words of those windows that hold one of the words of `rare` (token)."""
    half = width // 2
    count = F.greatest(F.ceil(F.size("ws") / half).cast("int") - 1, F.lit(1))
    window = lambda b: F.struct(b.alias("block"), F.array_distinct(F.slice("ws", b * half + 1, width)).alias("tokens"))
    if rare.count() <= max_lookup:
        lookup = cut_lineage(rare.agg(F.collect_set("token").alias("tokens"))).scalar()  # max_lookup words at most
        rows = rows.withColumn("rare", lookup)
        every = F.transform(F.sequence(F.lit(0), count - 1), window)
        held = F.filter(every, lambda x: F.arrays_overlap(x["tokens"], F.col("rare")))
        return rows.withColumn("blocks", F.when(F.arrays_overlap("ws", "rare"), held)).drop("rare")
    spots = rows.select("license_key", F.posexplode("ws").alias("at", "token")).join(rare, "token", "left_semi")
    both = F.array_distinct(F.array(F.greatest(F.floor(F.col("at") / half) - 1, F.lit(0)), F.floor(F.col("at") / half)))
    found = spots.select("license_key", F.explode(both.cast("array<int>")).alias("b")).distinct().groupBy("license_key").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    rows = rows.join(found, "license_key", "left")
    return rows.withColumn("blocks", F.transform(F.filter("bs", lambda b: b < count), window)).drop("bs")


def met(blocks: DataFrame, order: DataFrame, sets: DataFrame, small: bool) -> DataFrame:
    """license_key, label, score: the best containment of each label's parts that a block meets."""
    hint = F.broadcast if small else lambda df: df
    tokens = blocks.select("license_key", "block", F.explode("tokens").alias("token")).join(hint(order), "token")
    held = tokens.groupBy("license_key", "block").agg(F.array_sort(F.collect_set("place")).alias("held"))
    spread = held.select("license_key", "block", "held", F.posexplode("held").alias("j", "place"))
    prefix = sets.select("part", "label", "size", "need", "places", F.posexplode("places").alias("i", "place")).filter(F.col("i") <= F.col("size") - F.col("need"))
    left = 1 + F.least(F.col("size") - F.col("i") - 1, F.size("held") - F.col("j") - 1)
    long_enough = F.size("held") >= F.col("need")
    pairs = spread.join(hint(prefix), "place").filter(long_enough & (left >= F.col("need")))
    shared = F.size(F.array_intersect("held", "places"))
    good = pairs.select("license_key", "label", "size", "need", shared.alias("shared")).filter("shared >= need")
    return good.groupBy("license_key", "label").agg(F.max(F.col("shared") / F.col("size")).alias("score"))


def phrase_places(phrase: list[str]) -> Column:
    """Places (from 0) in ws where the phrase's words stand consecutively."""

    def at(w: Column, i: Column) -> Column:
        fits = w == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            fits = fits & (F.get("ws", i + k) == word)
        return F.when(fits, i)

    return F.filter(F.transform("ws", at), lambda i: i.isNotNull())


def scan(
    docs: DataFrame, templates: DataFrame, *, base: Sequence[tuple[str, str]] = tuple(PHRASES), id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, width: int = 64, max_lookup: int = 20_000
) -> DataFrame:
    """The id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Templates are rows (label, text). Score is 1 where a base phrase stands, else the best containment of a part that is met, else 0.
    """
    if not 0 < threshold <= 1 or width < 2 or width % 2:
        raise ValueError("threshold is over 0 and 1 at most, width an even number")
    spark = docs.sparkSession
    rows = with_words(docs, id_column, text_column)
    order, sets = ordered(template_parts(templates, width, threshold), rows, max_lookup)
    rare = cut_lineage(sets.select(F.explode(F.slice("places", 1, F.col("size") - F.col("need") + 1)).alias("p")).select("p.token").distinct())

    table = blocks_of(rows, rare, width, max_lookup)
    none = F.array().cast("array<int>")
    places = []
    for phrase, label in base:
        parts = re.findall(WORD, phrase.lower())
        # Most texts lack the rarest-looking word, which one pass over the words tells.
        places.append((label, F.when(F.array_contains("ws", max(parts, key=len)), phrase_places(parts)).otherwise(none)))
    found = table.select("license_key", F.size("ws").alias("n_words"), "blocks", *[p.alias(f"p{k}") for k, (_, p) in enumerate(places)])
    every = F.concat(none, *[f"p{k}" for k in range(len(places))])
    labels = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(places)]))
    found = found.select("license_key", F.col("n_words").cast("long").alias("n_words"), "blocks", every.alias("at"), F.array_sort(F.array_distinct(labels)).alias("base_labels"))
    path = scratch(spark, "license-blocks")  # without texts; read again for the join and for the rows
    found.write.parquet(path)
    found = spark.read.parquet(path)

    blocks = found.select("license_key", F.explode("blocks").alias("b")).select("license_key", "b.block", "b.tokens")
    hits = met(blocks, order, sets, order.count() <= max_lookup)
    per = hits.groupBy("license_key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    out = found.join(per.withColumnRenamed("license_key", "other"), F.col("license_key").eqNullSafe(F.col("other")), "left")
    every_label = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        F.col("license_key.id").alias(id_column), "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every_label, ",").alias("labels"), F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
