"""Operator 3, n-gram Jaccard join with a token-group matrix; exact.

1. Documents with equal shingle sets are one node, named by the set's 64-bit fingerprint.
2. Shingles get a global order: by the count of their hash bucket over the whole corpus (a table of fixed size), rare
   ones first. Two sets that are similar enough share a shingle among the first n - ceil(t n) + 1 of each (their prefixes),
   and the first one that they share leaves enough shingles behind it in both (its rest, itself included) for the overlap
   they need. Prefix shingles that more than one node has are kept as postings, in one exchange by shingle.
3. Groups of similar documents: the leaders of a posting are its few smallest nodes; each node is compared with the few
   leaders that it shares most postings with. Components of the links found are groups, split into blocks of bounded size
   by hash. A node that misses all its leaders stays a group of its own, and step 4 treats it exactly.
4. The matrix (shingle, block) holds the prefix shingles of all members of a block. Blocks of different components that
   share an entry and whose sizes and rests are compatible are candidates. Each node has a bitmap of its shingles, each block the
   union of its members' bitmaps: what a member has outside the other block's union bounds their overlap from above.
   Only pairs of blocks with a qualifying member are opened; their sets are then compared, and one link settles a pair.
5. Components of all links. Links within a component are never listed, so large groups of copies cost no pairs.

No link is lost: similar sets share a posting, and then are in one component or in two blocks that are opened.

Cases: a null or blank text has an empty set and links with nothing; a text of fewer words is one shingle; very long texts
are taken whole; repeated rows share a component; a null id has its class's component (null where no row of it has an id);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import by_bytes, components, cut_lineage, partitions
from lodestack.llm.shingles import fingerprints, shingle_sets, sort_rows

POSTING = "token long, node long, n int, rest int"


def ratio(threshold: float) -> tuple[int, int]:
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b|, for sorted distinct arrays."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    both = overlap(a, b)
    return den * both >= num * (len(a) + len(b) - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def bitmap(value: np.ndarray) -> bytes:
    """The set's bitmap by the low bits of its shingles, of a power of two of at least four bits a shingle."""
    bits = max(64, 1 << (4 * len(value) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(value & np.uint64(bits - 1)).astype("int64")] = True
    return np.packbits(out, bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def outside(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many elements of a's set are not in b's."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, size) & ~fold(b, size)).sum())


def may_link(a: np.ndarray, n: int, b: np.ndarray, m: int, num: int, den: int) -> bool:
    both = min(n - outside(a, b), m - outside(b, a))
    return den * both >= num * (n + m - both)


def sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in by_bytes(batches, "text", 1 << 20):  # hashing a text takes some forty times its bytes
        value, at = shingle_sets(batch.column("text"), words)
        yield batch, value, at, fingerprints(value, at)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that no run of equal values of the first column is parted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
        if cut:
            yield [x[:cut] for x in now]
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield held


def describe(docs: DataFrame, words: int) -> DataFrame:
    """A narrow row for each document: id, n (size of its set), node (fingerprint), and for the first of a node in its task the set's bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # as many numbers as the task has documents
        for batch, value, at, node in sets_of(batches, words):
            maps = [None if x in seen or seen.add(x) or a == b else bitmap(value[a:b]) for x, a, b in zip(node.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(node), pa.array(maps, pa.binary())], names=["id", "n", "node", "bits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, node long, bits binary")


def bucket_ranks(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Rank of each bucket (the top bits of a shingle) by how many shingles of all documents fall in it: 2**bits numbers."""
    chunk = 1 << max(0, bits - 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, "int64")
        for _, value, _, _ in sets_of(batches, words):
            seen += np.bincount((value >> np.uint64(64 - bits)).astype("int64"), minlength=len(seen))
        for k in range(0, len(seen), chunk):
            n = seen[k : k + chunk]
            at = np.flatnonzero(n)
            if 2 * len(at) < chunk:
                n = n[at]
            else:
                at = at[:0]  # all of them
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype("int32").tobytes()]), pa.array([n.astype("int32").tobytes()])], names=["k", "at", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(chunk, "int64")
        for at, n in zip(group.column("at").to_pylist(), group.column("n").to_pylist(), strict=True):
            total[np.frombuffer(at, "int32") if at else slice(None)] += np.frombuffer(n, "int32")
        return pa.table({"k": group.column("k").slice(0, 1), "n": [total.tobytes()]})

    parts = docs.select("text").mapInArrow(run, "k int, at binary, n binary")
    counts = np.zeros(1 << bits, "int64")
    for row in parts.groupBy("k").applyInArrow(add, "k int, n binary").collect():  # 16 rows, 2**bits numbers
        counts[row["k"] : row["k"] + chunk] = np.frombuffer(row["n"], "int64")
    ranks = np.empty(1 << bits, "uint32")
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << bits, dtype="uint32")
    return ranks


def ordered(value: np.ndarray, at: np.ndarray, ranks: np.ndarray, bits: int) -> np.ndarray:
    """The sets in the global order: the bucket's rank takes the place of the bucket, which changes nothing else."""
    low = np.uint64(64 - bits)
    value = (ranks[(value >> low).astype("int64")].astype("uint64") << low) | (value & np.uint64((1 << (64 - bits)) - 1))
    sort_rows(value, at)
    return value


def postings(docs: DataFrame, words: int, num: int, den: int, ranks: np.ndarray, bits: int) -> DataFrame:
    """POSTING rows of the prefix shingles that at least two nodes have."""
    table = docs.sparkSession.sparkContext.broadcast(ranks)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task's copies count once; as many numbers as the task has documents
        for _, value, at, node in sets_of(batches, words):
            n = np.diff(at)
            take = n - -(-num * n // den) + 1
            take[n == 0] = 0
            for i, x in enumerate(node.tolist()):
                if x in seen:
                    take[i] = 0
                seen.add(x)
            value = ordered(value, at, table.value, bits)
            place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            token, size = value[np.repeat(at[:-1], take) + place].view("int64"), np.repeat(n, take)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(node, take)), pa.array(size.astype("int32")), pa.array((size - place).astype("int32"))], names=["token", "node", "n", "rest"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node, n, rest in runs(batches):
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, n, rest = token[fresh], node[fresh], n[fresh], rest[fresh]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(start, len(token)))
            keep = np.repeat(length > 1, length)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, n, rest)], names=["token", "node", "n", "rest"])

    found = docs.select("text").mapInArrow(prefixes, POSTING)
    dealt = found.repartition(partitions(docs.sparkSession), "token").sortWithinPartitions("token", "node")
    return dealt.mapInArrow(shared, POSTING)


def enough(n: np.ndarray, rest: np.ndarray, m: np.ndarray, other_rest: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m shingles can still overlap enough, if this shingle is the first that they share."""
    return np.minimum(rest, other_rest).astype("int64") * (num + den) >= num * (n + m)


def meetings(shared: DataFrame, leaders: int, num: int, den: int) -> DataFrame:
    """(node, leader, times): how often a node shares a posting whose `leaders` smallest nodes have that leader, for the leaders met most often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node, n, rest in runs(batches):
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(start, len(token)))
            size = n.astype("int64")
            for k in range(leaders):
                lead = np.repeat(start + k, length)
                at = np.flatnonzero(np.repeat(length > k, length))
                lead = lead[at]
                fits = (node[at] > node[lead]) & enough(size[at], rest[at], size[lead], rest[lead], num, den)
                if fits.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[at[fits]]), pa.array(node[lead[fits]])], names=["node", "leader"])

    dealt = shared.repartition(partitions(shared.sparkSession), "token").sortWithinPartitions("token", "node")
    times = dealt.mapInArrow(run, "node long, leader long").groupBy("node", "leader").agg(F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("times"), "leader"))
    return times.withColumn("rank", rank).filter(F.col("rank") <= leaders).select("node", "leader")


def load_sets(docs: DataFrame, wanted: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(node, size, shingles) of the wanted nodes. A Bloom filter of bounded size keeps other documents out of the exchange; what it lets through goes with the join."""
    spark = docs.sparkSession
    n = wanted.count()
    bits = min(max_bits, max(1 << 10, 1 << int(12 * n).bit_length()))
    spots = wanted.select(F.explode(F.array(F.pmod("node", F.lit(bits)), F.pmod(F.shiftright("node", 31), F.lit(bits)))).alias("spot"))
    words_of = spots.groupBy(F.expr("spot div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("b")).toArrow()  # max_bits / 64 rows
    filled = np.zeros(bits // 64, "int64")
    filled[words_of["w"].to_numpy()] = words_of["b"].to_numpy()
    bloom = spark.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, value, at, node in sets_of(batches, words):
            hit = np.diff(at) > 0
            for spot in (node % bits, (node >> 31) % bits):
                hit &= (bloom.value[spot // 64] >> (spot % 64)) & 1 == 1
            rows = [i for i in np.flatnonzero(hit).tolist() if node[i] not in seen and not seen.add(node[i])]
            if rows:
                data = [value[at[i] : at[i + 1]].tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array([len(d) // 8 for d in data], pa.int64()), pa.array(data, pa.binary())], names=["node", "size", "shingles"])

    found = docs.select("text").mapInArrow(run, "node long, size long, shingles binary")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def jaccard_classes(
    docs: DataFrame,
    *,
    words: int = 5,
    threshold: float = 0.75,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_bits: int = 20,
    leaders: int = 8,
    block_shingles: int = 1 << 16,
    max_bloom_bits: int = 1 << 27,
) -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links reach) for each document."""
    num, den = ratio(threshold)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    nodes = cut_lineage(describe(texts, words))
    ranks = bucket_ranks(texts, words, bucket_bits)
    shared = cut_lineage(postings(texts, words, num, den, ranks, bucket_bits))

    stars = meetings(shared, leaders, num, den)
    maps = cut_lineage(nodes.filter("bits is not null").join(shared.select("node").distinct(), "node", "left_semi").select("node", "n", "bits").dropDuplicates(["node"]))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n, y, m = (batch.column(c).to_pylist() for c in ("x", "n", "y", "m"))
            may = [may_link(np.frombuffer(a, "uint8"), i, np.frombuffer(b, "uint8"), j, num, den) for a, i, b, j in zip(x, n, y, m, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [similar(np.frombuffer(a, "uint64"), np.frombuffer(b, "uint64"), num, den) for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bits = lambda node, n, blob: maps.select(F.col("node").alias(node), F.col("n").alias(n), F.col("bits").alias(blob))
    pairs = stars.select(F.col("node").alias("a"), F.col("leader").alias("b")).join(bits("a", "n", "x"), "a").join(bits("b", "m", "y"), "b")
    pairs = cut_lineage(pairs.select("a", "b", "x", "n", "y", "m").mapInArrow(bound, "a long, b long"))
    sets = cut_lineage(load_sets(texts, cut_lineage(ends(pairs)), words, max_bloom_bits))
    side = lambda node, blob: sets.select(F.col("node").alias(node), F.col("shingles").alias(blob))
    first = cut_lineage(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))
    near = components(first)

    # Blocks: parts of a component, with a bounded number of shingles.
    member = maps.join(near, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"))
    parts = member.groupBy("comp").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("parts")).filter("parts > 1")
    member = member.join(parts, "comp", "left")
    block = F.struct("comp", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    member = cut_lineage(member.select("node", "comp", F.xxhash64(block).alias("block")))

    matrix = shared.join(member, "node").groupBy("token", "block", "comp").agg(F.min("n").cast("long").alias("low"), F.max("rest").cast("long").alias("rest"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, block, comp, low, rest in runs(batches):
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            end = np.append(start[1:], len(token))
            mixed = np.flatnonzero(np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for a, b in zip(start[mixed].tolist(), end[mixed].tolist(), strict=True):
                for i in range(a, b - 1):
                    later = slice(i + 1, b)
                    may = (comp[later] != comp[i]) & enough(low[i], rest[i], low[later], rest[later], num, den)
                    other = block[later][may]
                    out.append((np.minimum(other, block[i]), np.maximum(other, block[i])))
                    size += len(other)
                    if size > 1 << 16:
                        yield unique_pairs(out)
                        out, size = [], 0
            if size:
                yield unique_pairs(out)

    dealt = matrix.select("token", "block", "comp", "low", "rest").repartition(partitions(docs.sparkSession), "token").sortWithinPartitions("token")
    opened = dealt.mapInArrow(candidates, "a long, b long").distinct()

    def qualify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array([block_bound(p, q, num, den) for p, q in zip(x, y, strict=True)], pa.bool_()))

    unions = cut_lineage(member.join(maps, "node").groupBy("block").agg(F.collect_list(F.struct("n", "bits")).alias("members")))
    held = lambda c, blob: unions.select(F.col("block").alias(c), F.col("members").alias(blob))
    opened = cut_lineage(opened.join(held("a", "x"), "a").join(held("b", "y"), "b").mapInArrow(qualify, "a long, b long"))

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True) if (x := block_link(p, q, num, den))]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    used = cut_lineage(member.join(ends(opened).withColumnRenamed("node", "block"), "block", "left_semi").select("node", "block"))
    found = load_sets(texts, used.select("node"), words, max_bloom_bits)
    blocks = cut_lineage(used.join(found, "node").groupBy("block").agg(F.collect_list(F.struct("node", "shingles")).alias("members")))
    held_sets = lambda c, blob: blocks.select(F.col("block").alias(c), F.col("members").alias(blob))
    second = opened.join(held_sets("a", "x"), "a").join(held_sets("b", "y"), "b").select("x", "y").mapInArrow(open_pairs, "a long, b long")

    linked = components(first.unionByName(second))
    comp = nodes.join(linked, "node", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("comp"))
    least = comp.filter("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    out = comp.join(least, "comp", "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def unique_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])


def block_bound(members: list[dict], queries: list[dict], num: int, den: int) -> bool:
    """Whether any query may link with a member: first by the union of the members' bitmaps, then by their own."""
    maps = [(m["n"], np.frombuffer(m["bits"], "uint8")) for m in members]
    size = min(len(b) for _, b in maps)
    union = np.bitwise_or.reduce(np.stack([fold(b, size) for _, b in maps]))
    for q in queries:
        bits, n = np.frombuffer(q["bits"], "uint8"), q["n"]
        if den * (n - outside(bits, union)) >= num * n and any(may_link(bits, n, b, m, num, den) for m, b in maps):
            return True
    return False


def block_link(members: list[dict], queries: list[dict], num: int, den: int) -> tuple[int, int] | None:
    """A link between two opened blocks, or None; the union of the one's sets bounds the overlap of each of the other's."""
    sets = [np.frombuffer(m["shingles"], "uint64") for m in members]
    union = np.unique(np.concatenate(sets)) if len(sets) > 1 else sets[0]
    for other in queries:
        query = np.frombuffer(other["shingles"], "uint64")
        if den * overlap(query, union) < num * len(query):
            continue
        for member, x in zip(members, sets, strict=True):
            if similar(query, x, num, den):
                return member["node"], other["node"]
    return None
