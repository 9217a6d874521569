"""Edges from text: mentions of known names, hyperlinks, and references in properties."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import hashing
from lodestack.functions import text as md

#: The shortest name that counts as a mention, and the marks that no hyperlink ends with.
SHORTEST_MENTION = 4
TRAILING = ".,;:!?"
WORD = r"[\p{L}\p{N}_-]"
LINKED = r"!?\[[^\]]*\]\((https?://[^\s)]+)\)"
BARE = r"(?<![(\[a-zA-Z0-9])https?://[^\s)\]]+"


def prose(column: str) -> Column:
    """The text without what holds no mention: code, headings, links in brackets. Lines keep their places."""

    def keep(text: str | None) -> str:
        lines = [""] * ((text or "").count("\n") + 1)
        for number, _, line in md.lines_outside_code(text or ""):
            if not md.heading_of(line):
                lines[number] = md.re.sub(r"`[^`]*`|!?\[\[[^\]\n]*\]\]", " ", line)
        return "\n".join(lines)

    return F.arrow_udf(hashing.one_by_one(keep), "string")(column)


def mentions(notes: DataFrame, names: DataFrame, key: str, text: str, block: int = 100_000) -> DataFrame:
    """key, target, n: how often each note's text has a name of a target; `names` has target and name, as in any case.

    A name has a letter, digit, `_` or `-` at least, and matches, with its other characters as they are, where none of these stands before or
    after it. Where names overlap, the first to start is taken, and of those the longest; of targets with the same name the smallest.
    One automaton (Aho-Corasick) finds all names of a block in one pass over a text; blocks hold about `block` names, so an
    automaton's size is bounded, and the texts are read once for each block. What is gathered for a note are its own matches only.
    """
    spelled = names.select("target", F.lower(F.trim("name")).alias("name"))
    spelled = spelled.filter((F.length("name") >= SHORTEST_MENTION) & F.col("name").rlike(WORD))
    known = spelled.groupBy("name").agg(F.min("target").alias("target"))
    blocks = -(-known.count() // block)
    low = notes.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))
    own, target = (df.schema[c].dataType.simpleString() for df, c in ((low, "key"), (known, "target")))
    kind = f"key {own}, at int, less int, target {target}"
    found = notes.sparkSession.createDataFrame([], kind)
    for number in range(blocks):
        held = known.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == number).toArrow()  # about `block` names
        if held.num_rows:
            found = found.unionByName(low.mapInArrow(_matcher(held["name"].to_pylist(), held["target"].to_pylist()), kind))
    per = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "less", "target"))).alias("found"))
    listed = per.schema["found"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("end"), F.expr(f"cast(array() as {listed})").alias("taken"))
    step = lambda s, m: F.when(m["at"] >= s["end"], F.struct((m["at"] - m["less"]).alias("end"), F.concat(s["taken"], F.array(m)).alias("taken"))).otherwise(s)
    taken = per.select("key", F.explode(F.aggregate("found", start, step, lambda s: s["taken"])).alias("m"))
    return taken.groupBy(F.col("key").alias(key), F.col("m.target").alias("target")).agg(F.count("*").alias("n"))


def _matcher(names: list[str], targets: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (key, text): key, at, less (the length, negative), target of all matches; at one place the longest."""

    def word(c: str) -> bool:
        return c.isalnum() or c in "_-"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            automaton.add_word(name, i)
        automaton.make_automaton()
        for batch in batches:
            row, at, which = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                best: dict[int, int] = {}
                for end, i in automaton.iter(text):
                    begin = end + 1 - len(names[i])
                    if (not begin or not word(text[begin - 1])) and (end + 1 == len(text) or not word(text[end + 1])):
                        best[begin] = i  # ends ascend, so the longest comes last
                row += [r] * len(best)
                at += best
                which += best.values()
            less = pa.array([-len(names[i]) for i in which], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), less, chosen.take(pa.array(which, pa.int64()))], names=["key", "at", "less", "target"])

    chosen = pa.array(targets)
    return run


def mention_edges(notes: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), target: one row for each line that mentions a target, of text that `prose` has masked."""
    lines = notes.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line_text"))
    spots = lines.select(F.struct(F.col(key), (F.col("at") + 1).alias("line")).alias("spot"), "line_text")
    return mentions(spots, names, "spot", "line_text").select(f"spot.{key}", "spot.line", "target")


def hyperlinks(notes: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), url: web links, Markdown or bare, each once a line, without marks at the end. A null text has none.

    The text is what `prose` leaves, so code and headings hold no links.
    """
    lines = notes.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line_text"))
    every = F.concat(F.regexp_extract_all("line_text", F.lit(LINKED), 1), F.regexp_extract_all("line_text", F.lit(BARE), 0))
    urls = F.transform(every, lambda u: F.rtrim(u, F.lit(TRAILING)))
    return lines.select(key, (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(urls)).alias("url"))


def property_refs(properties: DataFrame, aliases: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """note, rel, target of property rows (note, key, value): the target inside a value `[[...]]` of any key, as written; for the
    keys allowed, also the note whose alias a plain value is (`aliases` has id and alias; the smallest id wins)."""
    inner = F.regexp_extract("value", r"^\s*\[\[([^\[\]|#]+)", 1)
    linked = properties.select("note", F.col("key").alias("rel"), F.trim(inner).alias("target")).filter("target <> ''")
    by_name = aliases.groupBy(F.lower(F.trim("alias")).alias("name")).agg(F.min("id").cast("string").alias("target"))
    plain = properties.filter(F.col("key").isin(*allowed) & (inner == "")).withColumn("name", F.lower(F.trim("value")))
    return linked.unionByName(plain.join(by_name, "name").select("note", F.col("key").alias("rel"), "target")).distinct()
