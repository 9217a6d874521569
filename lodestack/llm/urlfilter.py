"""Operator 6, URL filters: a Bloom filter cascade gives exact membership without a join.

A page's candidate keys are its host and each parent domain, followed by its path cut to each length that a rule's path has.
Level 0 encodes the listed keys; level 1 those keys of the corpus that level 0 passes without being listed; level 2 the
listed keys that level 1 passes; and so on, until nothing passes wrongly. For every key of the corpus (the cascade's
universe, all pages) the first level that rejects it then decides exactly. The filters are arrays of 64-bit words that reach
the expressions as scalar subqueries; their size is known from the number of listed keys and checked.

All expressions are built in; pages are read in one narrow scan a cascade, and judged without a shuffle. A list whose filters would exceed
`max_bits` (some millions of rules) is no longer sent to the tasks: the distinct hosts and paths meet it by a join on their keys, with
the same result.

Cases: a null url, or one without `://`, has an empty host and path and fits no rule; an empty rule list lists nothing; a
rule given twice counts once, and block wins if it is given with both verdicts; the longest rule wins, of equally long
ones that with the longer host; earlier columns named as the outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (parent domain + path prefix) that a rule for this page could have, the longest first."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(fits, lambda n: F.struct(h.alias("h"), F.substr(path, F.lit(1), n).alias("p")))))
    ranked = F.transform(keys, lambda k: F.struct(-(F.length(k["h"]) + F.length(k["p"])), -F.length(k["h"]), F.concat(k["h"], k["p"]).alias("key")))
    return F.transform(F.array_sort(ranked), lambda k: k["key"])


class TooLarge(ValueError):
    """A filter or a cascade beyond its bounds."""


class Bloom:
    """One filter: `hashes` bits a key in `bits` bits, as an array of words behind a scalar subquery."""

    def __init__(self, keys: DataFrame, level: int, bits_per_key: int, hashes: int, max_bits: int):
        self.n = keys.count()
        self.bits = max(64, -(-self.n * bits_per_key // 64) * 64)
        if self.bits > max_bits:
            raise TooLarge(f"{self.n} keys need {self.bits} bits, more than max_bits={max_bits}")
        self.level, self.hashes = level, hashes
        spots = keys.select(F.explode(F.array(*self._spots(F.col("key")))).alias("spot"))
        words = spots.groupBy(F.expr("spot div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits"))
        # One row with bits / 64 words, written to the shared folder and read where a scalar subquery stands.
        every = keys.sparkSession.range(self.bits // 64).select(F.col("id").alias("w")).join(words, "w", "left")
        ordered = F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits"))))
        self.words = cut_lineage(every.agg(F.transform(ordered, lambda x: x["bits"]).alias("words"))).scalar()
        self.column = f"bloom_words_{uuid.uuid4().hex}"

    def _spots(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        """Needs the words as a column (`with_words`): subqueries can't stand in lambda functions."""
        out = F.lit(True)
        for spot in self._spots(key):
            word = F.element_at(self.column, (F.floor(spot / 64) + 1).cast("int"))
            out = out & (F.getbit(word, F.pmod(spot, F.lit(64)).cast("int")) == 1)
        return out


def with_words(df: DataFrame, blooms: list[Bloom]) -> DataFrame:
    return df.withColumns({b.column: b.words for b in blooms})


class Cascade:
    """Exact membership of every key of `universe` (column key) in `listed` (column key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, *, bits_per_key: int = 10, hashes: int = 5, max_bits: int = 1 << 26, max_levels: int = 24):
        listed = listed.select("key").distinct()
        self.levels: list[Bloom] = []
        yes, no = listed, None
        for level in range(max_levels):
            bloom = Bloom(yes if level % 2 == 0 else no, level, bits_per_key, hashes, max_bits)
            self.levels.append(bloom)
            if level == 0:
                universe = with_words(universe.select("key"), [bloom])
                # The only comparison with the list, of the few keys that pass by mistake; judging needs none.
                # Written once: all later levels and their counts read these keys, and not the pages again.
                no = cut_lineage(universe.filter(bloom.passes(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti"))
                left = no
            elif level % 2:
                yes = left = with_words(yes, [bloom]).filter(bloom.passes(F.col("key"))).select("key")
            else:
                no = left = with_words(no, [bloom]).filter(bloom.passes(F.col("key"))).select("key")
            if left.isEmpty():
                return
        raise TooLarge(f"keys still pass wrongly after {max_levels} levels")

    def holds(self, key: Column) -> Column:
        """A key that level i is the first to reject is listed if i is odd; one that all levels pass, if their number is odd."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, bloom in reversed(list(enumerate(self.levels))):
            out = F.when(bloom.passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def listed_rules(spark: SparkSession, rules: DataFrame | list[tuple[str, str, str]]) -> DataFrame:
    """key, sizes (of its path), verdict of rules given as a list or as rows (host, path, verdict); rules with a null are none."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rows = rules.filter("host is not null and path is not null and verdict in ('allow', 'block')")
    split = rows.select(F.concat("host", "path").alias("key"), F.length("path").alias("size"), "verdict")
    return split.groupBy("key").agg(F.collect_set("size").alias("sizes"), F.max("verdict").alias("verdict"))  # block wins


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], *, url_column: str = "url", default: str = "allow", **cascade) -> DataFrame:
    """All rows with host, path, rule (the longest listed key that fits, or null) and verdict (its own, else `default`).

    `rules` are (host, path, allow or block), as a list or as a DataFrame of any size. Listed keys and blocked keys have a cascade each,
    both over all keys of all pages. A page on which no rule fits is no member of the list, and gets the default.
    """
    spark = pages.sparkSession
    url = F.col(url_column)
    out = pages.drop(*(c for c in ("host", "path", "rule", "verdict") if c != url_column))
    out = out.withColumn("host", url_host(url)).withColumn("path", url_path(url))
    listed = cut_lineage(listed_rules(spark, rules))
    lengths = sorted((r[0] for r in listed.select(F.explode("sizes")).distinct().collect()), reverse=True)  # as many as paths have lengths
    if not lengths:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = out.select("host", "path").select(F.explode(keys).alias("key"))
    try:
        member = Cascade(listed, universe, **cascade)
        blocked = Cascade(listed.filter("verdict = 'block'"), universe.unionByName(listed.select("key")), **cascade)
    except TooLarge:
        return joined(out, keys, listed, default)
    levels = member.levels + blocked.levels
    out = with_words(out, levels).withColumn("rule", F.get(F.filter(keys, member.holds), F.lit(0)))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", verdict).drop(*(b.column for b in levels))


def joined(out: DataFrame, keys: Column, listed: DataFrame, default: str) -> DataFrame:
    """The same by a join: each distinct host and path is judged once, by the first of its keys that is listed."""
    pairs = out.select("host", "path").distinct().select("host", "path", F.posexplode(keys).alias("place", "key"))
    best = pairs.join(listed.select("key", "verdict"), "key").groupBy("host", "path").agg(F.min(F.struct("place", F.col("key").alias("rule"), "verdict")).alias("best"))
    found = out.join(best, ["host", "path"], "left")
    return found.withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))}).select(*out.columns, "rule", "verdict")
