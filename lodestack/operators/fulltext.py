"""Boolean full-text search: AND, OR, NOT, NEAR, prefixes, phrases and parentheses, scored by BM25.

A query is compiled on the driver into leaves, whose occurrences are counted by built-in expressions, and one condition on the
counts. `indexed` takes the counts from a stored index alone: it opens the files of the query's words (of a prefix, those that its words may
lie in), gathers a document's positions, and meets them as sets of places. `search` scans texts that have no index; they are
scanned for the statistics and for the hits and never shuffled, and one row of statistics is broadcast. Both give the same scores.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.postings import Index, View, weight
from lodestack.operators.retrieval import K1, B, words

OPERATORS = {"AND", "OR", "NOT"}


@dataclass(frozen=True)
class Leaf:
    kind: str  # word, prefix, phrase or near
    words: tuple[str, ...]
    within: int = 10

    def count(self, ws: str) -> Column:
        """How often it occurs in the array of words."""
        first = self.words[0]
        if self.kind == "prefix":
            return F.size(F.filter(ws, lambda w: w.startswith(first)))
        if self.kind == "near":
            places = lambda word: F.filter(F.transform(ws, lambda w, i: F.when(w == word, i)), lambda p: p.isNotNull())
            close = lambda p: _all([F.exists(places(word), _near(p, self.within)) for word in self.words[1:]])
            return F.size(F.filter(places(first), close))
        follows = lambda w, i: _all([w == first] + [F.get(ws, i + k) == word for k, word in enumerate(self.words) if k])
        return F.size(F.filter(ws, follows))

    def counted(self) -> Column:
        """How often it occurs, as an aggregate over a document's postings (term, tf, positions)."""
        if self.kind in ("word", "prefix"):
            own = F.col("term") == self.words[0] if self.kind == "word" else F.col("term").startswith(self.words[0])
            return F.coalesce(F.sum(F.when(own, F.col("tf"))), F.lit(0))
        places = [F.any_value(F.when(F.col("term") == word, F.col("positions")), F.lit(True)) for word in self.words]
        met = places[0]
        for k, other in enumerate(places[1:], 1):
            if self.kind == "near":
                reach = self.within + 1
                other = F.flatten(F.transform(other, lambda q: F.sequence(q - reach, q + reach)))
            else:
                other = _shifted(other, k)
            met = F.array_intersect(met, other)
        return F.coalesce(F.size(met), F.lit(0))


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda q: q - by)


def _near(p: Column, within: int) -> Callable[[Column], Column]:
    return lambda q: F.abs(p - q) <= within + 1


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


@dataclass
class Compiled:
    leaves: list[Leaf] = field(default_factory=list)
    scored: set[int] = field(default_factory=set)
    test: Callable[[], Column] | None = None


def compile_query(query: str) -> Compiled:
    """Quotes and colons go, parentheses too where they don't balance; operators without an operand are left out. A token with
    marks inside is a phrase of its words. Side by side binds closest, then NOT, AND, OR."""
    text = re.sub(r'[":]', " ", query)
    depth, low = 0, 0
    for c in text:
        depth += (c == "(") - (c == ")")
        low = min(low, depth)
    if depth or low < 0:
        text = re.sub(r"[()]", " ", text)
    todo = re.findall(r"[()]|[^\s()]+", text)
    out = Compiled()

    def leaf(kind: str, parts: list[str], positive: bool, within: int = 10):
        found = Leaf(kind, tuple(parts), within)
        if found not in out.leaves:
            out.leaves.append(found)
        at = out.leaves.index(found)
        if positive:
            out.scored.add(at)
        return lambda: F.col(f"tf{at}") > 0

    def join(op: str, a, b):
        if a is None or b is None:
            return a if op == "NOT" or b is None else b
        return {"AND": lambda: a() & b(), "OR": lambda: a() | b(), "NOT": lambda: a() & ~b()}[op]

    def primary(positive: bool):
        token = todo.pop(0)
        if token == "(":
            inner = level(0, positive)
            if todo:
                todo.pop(0)
            return inner
        if token == "NEAR" and todo[:1] == ["("] and ")" in todo:
            inside = " ".join(todo[1 : todo.index(")")])
            del todo[: todo.index(")") + 1]
            body, _, within = inside.partition(",")
            parts = re.findall(r"[a-z0-9]+", body.lower())
            size = int(within) if within.strip().isdigit() else 10
            return leaf("near" if len(parts) > 1 else "word", parts, positive, size) if parts else None
        parts = re.findall(r"[a-z0-9]+", token.lower())
        if not parts:
            return None
        if len(parts) == 1:
            return leaf("prefix" if token.endswith("*") else "word", parts, positive)
        return leaf("phrase", parts, positive)

    def side_by_side(positive: bool):
        found = None
        while todo and todo[0] != ")" and todo[0] not in OPERATORS:
            found = join("AND", found, primary(positive))
        return found

    def level(n: int, positive: bool):
        if n == 3:
            return side_by_side(positive)
        op = ("OR", "AND", "NOT")[n]
        found = level(n + 1, positive)
        while todo and todo[0] == op:
            todo.pop(0)
            found = join(op, found, level(n + 1, positive and op != "NOT"))
        return found

    out.test = level(0, True)
    return out


def matching(docs: DataFrame, query: str, key: str, text: str, keep: Column | None = None) -> DataFrame:
    """key, len and the count of each leaf (tf0, ...) of the documents that fit the query; an empty query fits none."""
    compiled = compile_query(query)
    counted = _counted(docs, compiled, key, text, keep)
    return counted.filter("keep").filter(compiled.test() if compiled.test else F.lit(False)).drop("keep")


def _counted(docs: DataFrame, compiled: Compiled, key: str, text: str, keep: Column | None) -> DataFrame:
    # A generator between, since a filter on counts would else be pushed below and split every text again for each leaf.
    body = docs.select(key, F.explode(F.array(words(F.col(text)))).alias("ws"), (keep if keep is not None else F.lit(True)).alias("keep"))
    return body.select(key, "keep", F.coalesce(F.size("ws"), F.lit(0)).alias("len"), *[leaf.count("ws").alias(f"tf{i}") for i, leaf in enumerate(compiled.leaves)])


def search(docs: DataFrame, query: str, key: str, text: str, k: int = 10, keep: Column | None = None) -> DataFrame:
    """The k best documents that fit the query: key, score. Leaves below NOT add no score; `keep` leaves the statistics alone."""
    compiled = compile_query(query)
    counted = _counted(docs, compiled, key, text, None)
    scored = sorted(compiled.scored)
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in scored])
    score = F.lit(0.0)
    for i in scored:
        n, df, f = F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    hits = matching(docs, query, key, text, keep).join(F.broadcast(stats))  # one row
    return hits.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def indexed(index: Index | View, query: str, k: int | None = 10, keep: DataFrame | None = None) -> DataFrame:
    """The k best documents of each and all vaults that fit the query, from the index's folders alone: vault, key, score.

    Each vault counts by its own statistics; ties go to the smaller vault, then key. `keep` (column key) leaves the statistics alone.
    """
    view = index.view() if isinstance(index, Index) else index
    compiled = compile_query(query)
    prefixes = sorted({leaf.words[0] for leaf in compiled.leaves if leaf.kind == "prefix"})
    terms = sorted({word for leaf in compiled.leaves if leaf.kind != "prefix" for word in leaf.words})
    rows = view.live(terms, prefixes, positions=any(leaf.kind in ("phrase", "near") for leaf in compiled.leaves))
    found = rows.groupBy("vault", "key", "len").agg(*[leaf.counted().alias(f"tf{i}") for i, leaf in enumerate(compiled.leaves)] or [F.count("*").alias("none")])
    scored = sorted(compiled.scored)
    stats = view.stats()
    if all(compiled.leaves[i].kind == "word" for i in scored):  # the dictionary knows them
        known = view.dictionary(terms).groupBy("vault").agg(F.lit(0).alias("df"), *[F.coalesce(F.sum(F.when(F.col("term") == compiled.leaves[i].words[0], F.col("df"))), F.lit(0)).alias(f"df{i}") for i in scored])
    else:
        known = found.groupBy("vault").agg(F.lit(0).alias("df"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in scored])
    hits = found.filter(compiled.test() if compiled.test else F.lit(False))
    if keep is not None:
        hits = hits.join(keep.select("key"), "key", "left_semi")
    hits = hits.join(F.broadcast(known.join(stats, "vault")), "vault")  # one row for each vault
    score = F.lit(0.0)
    for i in scored:
        part = weight(F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}"), F.col("len"), F.col("avg"))
        score = score + F.when(F.col(f"tf{i}") > 0, part).otherwise(0.0)
    out = hits.select("vault", "key", F.round(score, 6).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "vault", "key").limit(k)


def snippet(text: Column, terms: list[str], size: int = 64, before: int = 8) -> Column:
    """A window of `size` tokens that starts shortly before the first of the terms, each of which stands in <mark>."""
    tokens = F.split(F.trim(text), r"\s+")
    hit = lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]+", "").isin(terms)
    places = F.filter(F.transform(tokens, lambda t, i: F.when(hit(t), i)), lambda p: p.isNotNull())
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(0)) - before, F.lit(0)) + 1
    marked = F.transform(F.slice(tokens, start, F.lit(size)), lambda t: F.when(hit(t), F.concat(F.lit("<mark>"), t, F.lit("</mark>"))).otherwise(t))
    return F.array_join(marked, " ")
