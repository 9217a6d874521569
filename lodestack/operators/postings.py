"""A stored full-text index with positions: written once, read by term, changed by added segments, which are merged in time.

A segment has these tables, all Parquet:

- `postings` (term, vault, n, places, keys, lens, tfs, positions): a row is a block, a word's postings in some n documents of a vault,
  their positions (so many as places) one after the other; lens, tfs and positions are numbers of 1, 2 or 4 bytes each, keys of kind
  bigint what they are above the least of the block, others an array. Blocks are dealt out by ranges of (term, hash of the key), so that a frequent word
  fills several files and a rare one shares its own, and a range's are joined and sorted; how many files there are follows from the bytes.
  Where ranges part is told by a sample of the postings, which decides on sizes of files only;
- `terms` (term, vault, df), the dictionary, sorted by term: differences, which add up over the segments;
- `forward` (key, vault, text), in folders by a hash of the key: what a document was when it was indexed. Texts are
  dealt out and written once; all else of the segment is made of this table;
- `stats` (vault, n, words), differences as well; `gone` (key): whose rows in earlier segments no longer count;
- `ranges` (of, file, low, high): the terms that each file of `postings` and `terms` spans. A search opens only files that its words
  or prefixes fall into, and within these only row groups whose statistics hold them.

Replacing n documents reads the folders of their keys in `forward`, and no posting. The manifest names the segments that count
and changes by compare-and-rename: a reader sees whole segments, of two writers one fails with `Conflict`.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestack.operators.manifest import Conflict, Manifest
from lodestack.operators.retrieval import K1, B
from lodestack.runtime import ship

__all__ = ["Conflict", "Index", "View", "build"]

#: Parts that a word's rows may be spread over, documents of a folder of `forward`, and segments of about one size that are merged.
SPREAD, SLOT_DOCS, FAN = 64, 100_000, 8


#: Fixed value: bytes of text that a task takes apart at a time, or one text if that is longer.
SLICE = 1 << 21
#: Bytes of text whose postings fill a file, and the documents and postings of the sample that tells where files part.
FILE_TEXT, SAMPLE_DOCS, SAMPLE = 1 << 25, 2_000, 20_000
#: Slices whose postings are packed into blocks together, and postings at which a joined block ends.
PACK, BLOCK = 4, 1 << 13
#: Fixed value: rows of blocks that a task gives at a time.
ROWS = 10_000
#: How tables are written: the build is bound by what it writes and reads again.
SMALL = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: Fixed value: parts that a segment's documents are read in.
WAVES = 8
#: Lower-case letters and digits by byte, 0 for what divides words; and the other signs whose lower case has an ASCII letter.
LETTERS = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0 for b in range(256)], np.uint8)
FOREIGN = {"\u212a": "k", "\u0130": "i\u0307"}
#: The kinds of numbers in a block's lists, and what a block has beside its term and vault.
KINDS = [np.dtype(k) for k in ("<u1", "<u2", "<i4")]
LISTS = ("n", "places", "keys", "lens", "tfs", "positions")


def _in_order(numbers: np.ndarray) -> np.ndarray:
    """Places of small whole numbers in ascending order, equal ones as they stand: a sort of plain numbers is quicker than a stable argsort."""
    return np.sort((numbers.astype(np.int64) << 32) | np.arange(len(numbers))) & 0xFFFFFFFF


def spotted(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text (none null), as `retrieval.words` tells them: how many, the distinct ones of all texts in order, and
    for every place in turn the word's number, the text's, and which word of the text it is."""
    for sign, low in FOREIGN.items():
        if pc.any(pc.match_substring(texts, sign)).as_py():
            texts = pc.replace_substring(texts, sign, low)
    raw = texts.cast(pa.large_string())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = LETTERS[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    # A word starts at a letter or digit behind another sign, and at the head of a text; bytes of other alphabets divide.
    inside = data != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    first[heads] = inside[heads]
    heads = heads[heads > 0]
    last[heads - 1] = inside[heads - 1]
    starts = np.flatnonzero(first)
    offsets = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sizes = np.diff(np.searchsorted(starts, bounds))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = (np.arange(len(starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    return sizes.astype(np.int32), coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)], owner, place


def _forward(part: pa.RecordBatch) -> pa.RecordBatch:
    """vault, key, len, terms of (vault, key, text)."""
    sizes, terms, which, owner, _ = spotted(part.column(2))
    pairs = np.unique(owner * max(1, len(terms)) + which)
    row, term = np.divmod(pairs, max(1, len(terms)))
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes)))).astype(np.int32)
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), terms.take(pa.array(term)))], names=["vault", "key", "len", "terms"])


def _cuts(terms: pa.Array, term: np.ndarray, salt: np.ndarray, bounds: Sequence[tuple[str, int]]) -> np.ndarray:
    """For postings in the order of their terms, of which `term` is the number: how many of the sorted bounds aren't above (term, salt)."""
    words = sorted({t for t, _ in bounds})
    ends = np.array([bisect_right(terms, w, key=lambda t: t.as_py()) for w in words], np.int64)
    upto = np.append(0, np.cumsum([sum(t == w for t, _ in bounds) for w in words], dtype=np.int64))
    cut = upto[np.searchsorted(ends, term, side="right")]
    for at, w in enumerate(words):
        low = bisect_left(terms, w, key=lambda t: t.as_py())
        if low < ends[at]:  # a bound inside a word's postings
            own = slice(*np.searchsorted(term, [low, low + 1]))
            cut[own] = upto[at] + np.searchsorted([x for t, x in bounds if t == w], salt[own], side="right")
    return cut.astype(np.int32)


def _blocks(part: pa.RecordBatch, bounds: Sequence[tuple[str, int]] = ()) -> pa.RecordBatch:
    """term, vault, n, places, keys, lens, tfs, positions, cut of (vault, key, text, salt): a row for each word, vault and range, sorted by term.

    A posting's range depends on its word and key alone, not on what else is in the batch.
    """
    salt = part.column(3).to_numpy() if part.num_columns > 3 else np.zeros(part.num_rows, np.int64)
    vault = pc.fill_null(part.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    docs = np.lexsort((salt, vault))  # so ranges don't alternate among a word's documents
    salt, vault, part = salt[docs], vault[docs], part.take(pa.array(docs))
    sizes, terms, which, owner, place = spotted(part.column(2))
    pairs = which * max(1, len(sizes)) + owner
    order = _in_order(which)  # texts are in turn already
    ordered = pairs[order]
    group = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    term, row = np.divmod(ordered[group], max(1, len(sizes)))
    cut = _cuts(terms, term, salt[row], bounds)
    fresh = (np.diff(term) != 0) | (np.diff(vault[row]) != 0) | (np.diff(cut) != 0)
    heads = np.flatnonzero(np.append(True, fresh)[: len(term)])
    return pa.RecordBatch.from_arrays(
        [terms.take(pa.array(term[heads])), part.column(0).take(pa.array(row[heads])), *_lists(heads, part.column(1).take(pa.array(row)), sizes[row], np.diff(np.append(group, len(order))), place[order]), pa.array(cut[heads])],
        names=["term", "vault", *LISTS, "cut"],
    )


def _lists(heads: np.ndarray, keys: pa.Array, lens: np.ndarray, tfs: np.ndarray, places: np.ndarray) -> list[pa.Array]:
    """n, places, keys, lens, tfs, positions of the blocks that start at the heads."""
    ends = np.append(heads, len(keys))
    inner = np.append(0, np.cumsum(tfs))[ends]
    return [pa.array(np.diff(ends).astype(np.int32)), pa.array(np.diff(inner).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), keys), _narrow(ends, lens), _narrow(ends, tfs), _narrow(inner, places)]


def _narrow(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary for each list that ends there: its numbers (none below 0) in the narrowest kind that holds all; `_wide` tells the kind by the bytes."""
    kind = next(k for k in KINDS if k.itemsize == 4 or values.max(initial=0) >> 8 * k.itemsize == 0)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(values.astype(kind))])


def _wide(lists: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The numbers of lists of so many each, one after the other."""
    raw = lists.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    out = np.empty(counts.sum(), np.int32)
    for kind in KINDS:
        own = np.diff(bounds) == counts * kind.itemsize
        out[np.repeat(own, counts)] = data[np.repeat(own, np.diff(bounds))].view(kind)
    return out


def _runs(part: pa.RecordBatch, bounds: Sequence[tuple[str, int]] = ()) -> pa.RecordBatch:
    """cut, blocks of (vault, key, text, salt): a row for each range, its blocks as one Arrow stream, which takes far less room than a row for each."""
    blocks = _blocks(part, bounds)
    cut = blocks.column(blocks.num_columns - 1).to_numpy()
    blocks = blocks.select(["term", "vault", *LISTS])
    if (np.diff(cut) < 0).any():  # a word's ranges recur in each vault
        order = np.argsort(cut, kind="stable")
        cut, blocks = cut[order], blocks.take(pa.array(order))
    heads = np.flatnonzero(np.append(True, np.diff(cut) != 0)[: len(cut)])
    streams = []
    for at, to in zip(heads, np.append(heads[1:], len(cut)), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, blocks.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(blocks.slice(at, to - at))
        streams.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(cut[heads], pa.int32()), pa.array(streams, pa.binary())], names=["cut", "blocks"])


def _gathered(counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the items of lists of so many each lie, if the lists come in another order."""
    starts, sizes = (np.cumsum(counts, dtype=np.int64) - counts)[order], counts[order].astype(np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the runs of one range: its blocks by term and vault, those of one word and vault joined up to about BLOCK postings."""
    runs = [block for batch in batches for run in batch.column(batch.schema.get_field_index("blocks")) for block in pa.ipc.open_stream(run.as_buffer())]
    if not runs:
        return
    whole = pa.Table.from_batches(runs).combine_chunks()
    column = {name: whole.column(name).combine_chunks() for name in whole.column_names}
    coded = column["term"].dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    vaults = column["vault"].dictionary_encode()
    word = rank[coded.indices.to_numpy()] * (len(vaults.dictionary) + 1) + pc.fill_null(vaults.indices, -1).to_numpy() + 1
    order = np.argsort(word, kind="stable")
    word, n, places = word[order], column["n"].to_numpy(), column["places"].to_numpy()
    at, spot = _gathered(n, order), _gathered(places, order)
    before = np.cumsum(n[order], dtype=np.int64) - n[order]
    first = np.append(True, np.diff(word) != 0)[: len(word)]
    piece = (before - before[np.flatnonzero(first)][np.cumsum(first) - 1]) // BLOCK
    heads = np.flatnonzero(first | np.append(True, np.diff(piece) != 0)[: len(word)])
    lists = _lists(before[heads], column["keys"].flatten().take(pa.array(at)), _wide(column["lens"], n)[at], _wide(column["tfs"], n)[at], _wide(column["positions"], places)[spot])
    own = pa.array(order[heads])
    blocks = pa.RecordBatch.from_arrays([column["term"].take(own), column["vault"].take(own), *lists], names=["term", "vault", *LISTS])
    for row in range(0, blocks.num_rows, ROWS):
        yield _stored(blocks.slice(row, ROWS))


def _stored(part: pa.RecordBatch) -> pa.RecordBatch:
    """Blocks as they are written: of keys of kind bigint the least, and of each in turn what it is above that, in 1, 2, 4 or 8 bytes."""
    place = part.schema.get_field_index("keys")
    if not pa.types.is_list(part.column(place).type) or not pa.types.is_int64(part.column(place).type.value_type):
        return part
    n, keys = part.column(part.schema.get_field_index("n")).to_numpy().astype(np.int64), part.column(place).flatten().to_numpy()
    heads = np.cumsum(n) - n
    least = np.minimum.reduceat(keys, heads) if len(n) else keys
    above = (keys - np.repeat(least, n)).view(np.uint64)
    most = np.maximum.reduceat(above, heads) if len(n) else above
    width = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    ends = np.append(0, np.cumsum(8 + n * width))
    data, head = np.empty(ends[-1], np.uint8), ends[:-1, None] + np.arange(8)
    data[head] = least.view(np.uint8).reshape(-1, 8)
    wide = np.repeat(width, np.diff(ends))
    wide[head] = 0
    for size in (1, 2, 4, 8):
        data[wide == size] = above[np.repeat(width == size, n)].astype(f"<u{size}").view(np.uint8)
    packed_keys = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return part.set_column(place, "keys", packed_keys)


def _keys(lists: pa.Array, n: np.ndarray) -> pa.Array:
    """The keys of blocks of n each, one after the other, be they stored or arrays."""
    if pa.types.is_list(lists.type):
        return lists.flatten()
    raw = lists.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends, n = ends - ends[0], n.astype(np.int64)
    width, head = (np.diff(ends) - 8) // np.maximum(n, 1), ends[:-1, None] + np.arange(8)
    out = np.repeat(np.ascontiguousarray(data[head]).view(np.int64).reshape(-1), n)
    wide = np.repeat(width, np.diff(ends))
    wide[head] = 0
    for size in (1, 2, 4, 8):
        out[np.repeat(width == size, n)] += data[wide == size].view(f"<u{size}").astype(np.uint64).view(np.int64)
    return pa.array(out)


def _unpacked(part: pa.RecordBatch) -> pa.RecordBatch:
    """term, vault, key, len, tf, and positions if they are there, of blocks."""
    column = dict(zip(part.schema.names, part.columns, strict=True))
    n = column["n"].to_numpy()
    at, tfs = pa.array(np.repeat(np.arange(part.num_rows), n)), _wide(column["tfs"], n)
    columns = [column["term"].take(at), column["vault"].take(at), _keys(column["keys"], n), pa.array(_wide(column["lens"], n)), pa.array(tfs)]
    if "positions" in column:
        ends = np.append(0, np.cumsum(tfs)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(_wide(column["positions"], column["places"].to_numpy()))))
    return pa.RecordBatch.from_arrays(columns, names=["term", "vault", "key", "len", "tf", "positions"][: len(columns)])


def _packed(part: pa.RecordBatch) -> pa.RecordBatch:
    """Blocks of postings that are sorted by term and vault."""
    column = dict(zip(part.schema.names, part.columns, strict=True))
    codes = [pc.fill_null(column[c].dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in ("term", "vault")]
    heads = np.flatnonzero(np.append(True, (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0))[: part.num_rows])
    at = pa.array(heads)
    lists = _lists(heads, column["key"], column["len"].to_numpy(), column["tf"].to_numpy(), column["positions"].flatten().to_numpy())
    return pa.RecordBatch.from_arrays([column["term"].take(at), column["vault"].take(at), *lists], names=["term", "vault", *LISTS])


def _postings(part: pa.RecordBatch) -> pa.RecordBatch:
    """term, vault, key, len, tf, positions of (vault, key, text), sorted by term."""
    return _unpacked(_blocks(part))


def _each(run: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: batch by batch."""
    return lambda batches: (run(batch) for batch in batches)


def _by_slices(run: Callable[[pa.RecordBatch], pa.RecordBatch], slices: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (vault, key, text): parts of so many slices at a time, whatever a batch has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE * slices, side="right")))
                yield run(batch.slice(at, to - at))
                at = to

    return each


def told(docs: DataFrame, key: str, text: str, vault: str | None) -> DataFrame:
    """vault, key, text (a null text has no words)."""
    name = F.col(vault).cast("string") if vault else F.lit("")
    ship(docs.sparkSession)
    return docs.select(name.alias("vault"), F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))


def prepared(docs: DataFrame, key: str, text: str, vault: str | None) -> DataFrame:
    """`told`, dealt out by key, since a table may be one file of one row group."""
    return told(docs, key, text, vault).repartition("key")


def forward_of(docs: DataFrame) -> DataFrame:
    """vault, key, len, terms of each prepared document."""
    return docs.select("vault", "key", "text").mapInArrow(_by_slices(_forward), f"vault string, key {docs.schema['key'].dataType.simpleString()}, len int, terms array<string>")


def block_kind(key: str) -> str:
    """The schema of stored blocks by the key's type."""
    return f"term string, vault string, n int, places int, keys {'binary' if key == 'bigint' else f'array<{key}>'}, lens binary, tfs binary, positions binary"


def blocks_of(docs: DataFrame, bounds: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """Blocks of the words of documents, a partition for each range, by term and vault. They are packed in the batch, shuffled as one
    row for a batch and range, and joined in the range's task, which holds the postings of about FILE_TEXT of text."""
    runs = docs.select("vault", "key", "text", salt().alias("salt")).mapInArrow(_by_slices(lambda part: _runs(part, bounds), PACK), "cut int, blocks binary")
    return runs.repartitionById(len(bounds) + 1, F.col("cut")).mapInArrow(_joined, block_kind(docs.schema["key"].dataType.simpleString()))


def postings_of(docs: DataFrame) -> DataFrame:
    """term, vault, key, len, tf, positions of each word of each prepared document."""
    return docs.select("vault", "key", "text").mapInArrow(_by_slices(_postings), f"term string, vault string, key {docs.schema['key'].dataType.simpleString()}, len int, tf int, positions array<int>")


def unpacked(blocks: DataFrame, positions: bool = True) -> DataFrame:
    """term, vault, key, len, tf and, if wanted, positions of blocks."""
    rows = blocks.select("term", "vault", "n", "keys", "lens", "tfs", *(["places", "positions"] if positions else []))
    keys = rows.schema["keys"].dataType
    kind = f"term string, vault string, key {keys.elementType.simpleString() if isinstance(keys, ArrayType) else 'bigint'}, len int, tf int"
    return rows.mapInArrow(_each(_unpacked), f"{kind}, positions array<int>" if positions else kind)


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of postings that lie sorted by term and vault in their partitions."""
    return rows.select("term", "vault", "key", "len", "tf", "positions").mapInArrow(_each(lambda part: _stored(_packed(part))), block_kind(rows.schema["key"].dataType.simpleString()))


def bounds_of(docs: DataFrame, size: int, files: int) -> list[tuple[str, int]]:
    """Where about equal ranges of (term, salt) part, by a sample of at most SAMPLE postings of about SAMPLE_DOCS documents."""
    some = docs if size <= SAMPLE_DOCS else docs.filter(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < (SAMPLE_DOCS << 20) // size)
    rows = postings_of(some).select("term", salt().alias("salt"), F.xxhash64("term", "key").alias("draw"))
    drawn = sorted((r["term"], r["salt"]) for r in rows.orderBy("draw").limit(SAMPLE).select("term", "salt").collect())
    return sorted({drawn[len(drawn) * i // files] for i in range(1, files)}) if drawn else []


def salt() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int")


def slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int")


class View:
    """The segments of one version. What is read of it stays the same whatever is written meanwhile."""

    def __init__(self, spark: SparkSession, path: str, version: int, content: dict[str, Any]):
        self.spark, self.path, self.version, self.content = spark, path, version, content
        self.segments: list[dict[str, Any]] = content["segments"]

    def _table(self, at: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{self.segments[at]['id']}/{name}")

    def read(self, name: str) -> DataFrame:
        """A table of all segments, with the segment's place."""
        return reduce(DataFrame.unionByName, [self._table(at, name).withColumn("segment", F.lit(at)) for at in range(len(self.segments))])

    def _files(self, of: str, terms: Sequence[str], prefixes: Sequence[str]) -> dict[int, list[str]]:
        """By segment the files of postings or terms that may hold the words, or words with the prefixes."""
        test = F.lit(False)
        for t in terms:
            test = test | ((F.col("low") <= t) & (F.col("high") >= t))
        for p in prefixes:
            test = test | ((F.substring("low", 1, len(p)) <= p) & (F.col("high") >= p))
        found: dict[int, list[str]] = {}
        for row in self.read("ranges").filter(F.col("of") == of).filter(test).collect():  # as many as hold the query's words
            found.setdefault(row["segment"], []).append(f"{self.path}/segments/{self.segments[row['segment']]['id']}/{of}/{row['file']}")
        return found

    def _of(self, of: str, terms: Sequence[str] | None, prefixes: Sequence[str], each: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """A table's rows of the words and prefixes, or all, with the segment's place; `each` is made of a segment's rows."""
        if terms is None:
            parts = [(at, self._table(at, of)) for at in range(len(self.segments))]
        else:
            test = F.col("term").isin(*terms) if terms else F.lit(False)
            for p in prefixes:
                test = test | F.col("term").startswith(p)
            found = sorted(self._files(of, terms, prefixes).items())
            parts = [(at, self.spark.read.parquet(*sorted(files)).filter(test)) for at, files in found] or [(0, self._table(0, of).filter(F.lit(False)))]
        return reduce(DataFrame.unionByName, [each(rows).withColumn("segment", F.lit(at)) for at, rows in parts])

    def _counting(self, rows: DataFrame, first: int = 0) -> DataFrame:
        """Rows (key, segment) that no later segment replaced."""
        later = [self._table(at, "gone").select(F.col("key").alias("gone_key"), F.lit(at).alias("gone_at")) for at in range(first + 1, len(self.segments))]
        if not later:
            return rows
        gone = reduce(DataFrame.unionByName, later).groupBy("gone_key").agg(F.max("gone_at").alias("gone_at"))
        return rows.join(gone, (F.col("key") == F.col("gone_key")) & (F.col("segment") < F.col("gone_at")), "left_anti")

    def live(self, terms: Sequence[str] | None = None, prefixes: Sequence[str] = (), *, positions: bool = True) -> DataFrame:
        """The postings that count, with or without positions: of all words, or of the given ones and those with the given prefixes."""
        return self._counting(self._of("postings", terms, prefixes, lambda rows: unpacked(rows, positions))).drop("segment")

    def dictionary(self, terms: Sequence[str] | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
        """term, vault, df of the words that stand in a document."""
        return self._of("terms", terms, prefixes).groupBy("term", "vault").agg(F.sum("df").alias("df")).filter("df > 0")

    def stats(self) -> DataFrame:
        """vault, n, avg: documents and their mean words."""
        return self.read("stats").groupBy("vault").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avg")).filter("n > 0")

    def held(self, keys: DataFrame) -> DataFrame:
        """key, vault, len, terms as the index has the documents of these keys (distinct), from the folders of `forward` that can hold them."""
        parts = []
        for at, segment in enumerate(self.segments):
            slots = segment["slots"]
            wanted = [r[0] for r in keys.select(slot(slots).alias("s")).distinct().collect()] if slots > 1 else [0]  # one for each folder at most
            parts.append(self._table(at, "forward").filter(F.col("slot").isin(*wanted) if wanted else F.lit(False)).withColumn("segment", F.lit(at)))
        rows = reduce(DataFrame.unionByName, parts).join(keys, "key", "left_semi")
        return forward_of(self._counting(rows)).select("key", "vault", "len", "terms")

    def bm25(self, query: Sequence[str], k: int | None, *, every: bool = False, keep: DataFrame | None = None) -> DataFrame:
        """vault, key, score of the documents with one of the words (`every`: all of them), each vault by its own statistics.

        `keep` (column key) filters what is returned, not the statistics. With `k` the best k of all, ties to the smaller key.
        """
        terms = sorted(set(query))
        rows = self.live(terms, positions=False)
        if keep is not None:
            rows = rows.join(keep.select("key"), "key", "left_semi")
        one = rows.join(F.broadcast(self.dictionary(terms)), ["term", "vault"]).join(F.broadcast(self.stats()), "vault")  # a row for each word and vault, for each vault
        scored = one.groupBy("vault", "key").agg(F.round(F.sum(weight(F.col("n"), F.col("df"), F.col("tf"), F.col("len"), F.col("avg"))), 6).alias("score"), F.count("*").alias("found"))
        if every:
            scored = scored.filter(F.col("found") == len(terms))
        scored = scored.drop("found")
        return scored if k is None else scored.orderBy(F.desc("score"), "key").limit(k)


def weight(n: Column, df: Column, tf: Column, size: Column, avg: Column) -> Column:
    """A word's part of BM25."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avg))


class Index:
    """The index in a folder: views of its versions, and changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path, Manifest(spark, path)

    def view(self, version: int | None = None) -> View:
        return View(self.spark, self.path, *self.manifest.read(version))

    def read(self, name: str) -> DataFrame:
        return self.view().read(name)

    def live(self, terms: Sequence[str] | None = None) -> DataFrame:
        return self.view().live(terms)

    def bm25(self, query: Sequence[str], k: int | None, *, every: bool = False, keep: DataFrame | None = None) -> DataFrame:
        return self.view().bm25(query, k, every=every, keep=keep)

    def _write(self, segment: str, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/segments/{segment}/{name}"
        rows.write.options(**SMALL).parquet(path)
        return self.spark.read.parquet(path)

    def _write_sorted(self, segment: str, blocks: DataFrame, terms: DataFrame | None, fewer: DataFrame | None = None) -> DataFrame:
        """postings, which lie by ranges of terms and sorted, terms, and what each of their files spans; terms not given are counted from the
        postings, less those of `fewer` (df below 0). Gives vault, words of the postings, from the table `held`, which the caller drops."""
        written = self._write(segment, "postings", blocks)
        # Counted for each file at once: the rows are sorted, so what is left is about the dictionary.
        held = self._write(segment, "held", written.groupBy(F.col("_metadata.file_name").alias("file"), "term", "vault").agg(F.sum("n").alias("df"), F.sum("places").alias("words")))
        if terms is None:
            counts = held.select("term", "vault", "df")
            terms = (counts if fewer is None else counts.unionByName(fewer)).groupBy("term", "vault").agg(F.sum("df").alias("df")).filter("df <> 0")
        known = self._write(segment, "terms", terms.repartitionByRange("term").sortWithinPartitions("term", "vault"))
        spans = [rows.groupBy(name.alias("file")).agg(F.min("term").alias("low"), F.max("term").alias("high")).withColumn("of", F.lit(of)) for of, rows, name in (("postings", held, F.col("file")), ("terms", known, F.col("_metadata.file_name")))]
        self._write(segment, "ranges", spans[0].unionByName(spans[1]).coalesce(1))
        return held.groupBy("vault").agg(F.sum("words").alias("words"))

    def _write_forward(self, segment: str, rows: DataFrame, docs: int) -> int:
        """forward, in folders for about so many documents; how many folders."""
        slots = max(1, -(-docs // SLOT_DOCS))
        rows.withColumn("slot", slot(slots)).repartition("slot", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SPREAD))).sortWithinPartitions("slot", "key").write.options(**SMALL).partitionBy("slot").parquet(f"{self.path}/segments/{segment}/forward")
        if not docs:  # an empty table by folders has no schema to read
            rows.withColumn("slot", F.lit(0)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/segments/{segment}/forward")
        return slots

    def _dealt(self, segment: str) -> DataFrame:
        """The table forward, read in up to WAVES parts, which gives each core some tasks: one more task than cores would double the time."""
        path = f"{self.path}/segments/{segment}/forward"
        folders = sorted(s.getPath().getName() for s in self.manifest.fs.listStatus(self.manifest._path(path)) if s.isDirectory())
        read = self.spark.read.option("basePath", path)
        parts = [read.parquet(*[f"{path}/{f}" for f in folders[at::WAVES]]) for at in range(min(WAVES, len(folders)))]
        return reduce(DataFrame.unionByName, parts) if parts else read.parquet(path)

    def _drawn(self, segment: str, docs: int) -> DataFrame:
        """Some whole files of forward with at least about SAMPLE_DOCS documents, spread over the folders: which file a document is in
        follows from a hash of its key, so they are a sample that leaves the other texts unread."""
        path = f"{self.path}/segments/{segment}/forward"
        folders = sorted((s.getPath() for s in self.manifest.fs.listStatus(self.manifest._path(path)) if s.isDirectory()), key=str) or [self.manifest._path(path)]
        files = sorted(str(s.getPath()) for folder in folders for s in self.manifest.fs.listStatus(folder) if s.getPath().getName().endswith(".parquet"))
        few = min(len(files), -(-4 * SAMPLE_DOCS * len(files) // max(docs, 1)))
        return self.spark.read.option("basePath", path).parquet(*[files[len(files) * at // few] for at in range(few)])

    def _add(self, base: View, docs: DataFrame, gone: DataFrame | None, source: str | None = None, batch: int | None = None, noted: dict[str, Any] | None = None) -> None:
        """A segment of documents as `told`, which replaces the keys of `gone`, after those of `base`."""
        segment = uuid.uuid4().hex
        slots = self._write_forward(segment, docs.select("key", "vault", "text"), docs.count())
        docs = self._dealt(segment)
        size = docs.count()
        drawn = self._drawn(segment, size)
        some, text = drawn.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        text = text * size // max(some, 1)
        changes, fewer = [docs.groupBy("vault").agg(F.count("*").alias("n"), F.lit(0).alias("words"))], None
        if gone is None:
            self._write(segment, "gone", docs.select("key").limit(0))
        else:
            held = self._write(segment, "replaced", base.held(self._write(segment, "gone", gone)))
            changes.append(held.groupBy("vault").agg((-F.count("*")).alias("n"), (-F.sum("len")).alias("words")))
            fewer = held.select("vault", F.explode("terms").alias("term")).groupBy("term", "vault").agg((-F.count("*")).alias("df"))
        bounds = bounds_of(drawn, some, max(self.spark.sparkContext.defaultParallelism, -(-text // FILE_TEXT)))
        words = self._write_sorted(segment, blocks_of(docs, bounds), None, fewer)
        changes.append(words.select("vault", F.lit(0).alias("n"), "words"))
        stats = reduce(DataFrame.unionByName, changes).groupBy("vault").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
        self._write(segment, "stats", stats.coalesce(1))
        for name in ("held", "replaced"):
            self._drop(segment, name)
        content = dict(base.content, segments=[*base.segments, {"id": segment, "docs": size, "slots": slots}], **(noted or {}))
        self._commit(base, content, [segment], source, batch)

    def _commit(self, base: View, content: dict[str, Any], fresh: list[str], source: str | None = None, batch: int | None = None) -> None:
        if source is not None:
            content["batches"] = dict(content["batches"], **{source: batch})
        try:
            self.manifest.commit(base.version, content)
        except Conflict:
            for segment in fresh:
                self._drop(segment)
            raise

    def _drop(self, segment: str, name: str = "") -> None:
        """A segment, or one table of it."""
        self.manifest.fs.delete(self.manifest._path(f"{self.path}/segments/{segment}/{name}".rstrip("/")), True)

    def replace(self, docs: DataFrame, removed: DataFrame, key: str, text: str, vault: str | None = None, *, source: str | None = None, batch: int | None = None, base: View | None = None, noted: dict[str, Any] | None = None) -> bool:
        """A new segment: `docs` instead of the rows of their keys, and none for the keys of `removed` (column key).

        With `source`, the same batch (or an earlier one) of that stream is taken once: a repeated one changes nothing and gives False.
        Raises `Conflict` if another writer came between; nothing of the change is then seen. What is `noted` goes into the manifest with it.
        """
        base = base or self.view()
        if source is not None and base.content["batches"].get(source, -1) >= batch:
            return False
        gone = docs.select(F.col(key).alias("key")).unionByName(removed.select("key")).distinct()
        self._add(base, told(docs, key, text, vault), gone, source, batch, noted)
        return True

    def merge(self, fan: int = FAN) -> bool:
        """Join the last segments into one if there are `fan` of about one size (a power of `fan`) or smaller; True if so.

        Rows that were replaced among them go. Keys that they replaced in earlier segments stay known; differences are added up.
        """
        base = self.view()
        power = lambda s: len(range(1, max(1, s["docs"]).bit_length(), max(1, fan.bit_length() - 1)))
        run = 0
        for size in sorted({power(s) for s in base.segments}):
            run = next((n for n, s in enumerate(reversed(base.segments)) if power(s) > size), len(base.segments))
            if run >= fan:
                break
        if run < max(fan, 2):
            return False
        first = len(base.segments) - run
        among = View(self.spark, self.path, base.version, dict(base.content, segments=base.segments[first:]))
        segment = uuid.uuid4().hex
        keys = among.read("gone").select("key").distinct()
        self._write(segment, "gone", keys if first else keys.limit(0))
        sums = lambda name, by, *what: among.read(name).groupBy(*by).agg(*[F.sum(c).alias(c) for c in what])
        self._write(segment, "stats", sums("stats", ["vault"], "n", "words").coalesce(1))
        rows = among._counting(among.read("forward")).select("key", "vault", "text")
        docs = rows.count()
        slots = self._write_forward(segment, rows, docs)
        dealt = among.live().withColumn("part", salt()).repartitionByRange("term", "part").sortWithinPartitions("term", "vault", "key")
        self._write_sorted(segment, packed(dealt), sums("terms", ["term", "vault"], "df").filter("df <> 0"))
        self._drop(segment, "held")
        content = dict(base.content, segments=[*base.segments[:first], {"id": segment, "docs": docs, "slots": slots}])
        self._commit(base, content, [segment])
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Delete the segments that none of the last `keep` versions names; how many. Not while a writer is at work."""
        versions = self.manifest.versions()
        named = {s["id"] for v in versions[-max(keep, 1) :] for s in self.manifest.read(v)[1]["segments"]}
        there = [s.getPath().getName() for s in self.manifest.fs.listStatus(self.manifest._path(f"{self.path}/segments"))]
        old = [s for s in there if s not in named]
        for s in old:
            self._drop(s)
        for v in versions[: -max(keep, 1)]:
            self.manifest.fs.delete(self.manifest._path(f"{self.manifest.base}/{v:012d}.json"), False)
        return len(old)


def build(docs: DataFrame, path: str, key: str, text: str, vault: str | None = None) -> Index:
    """Write the index of all documents; keys are unique. A folder that has an index already is a `Conflict`."""
    index = Index(docs.sparkSession, path)
    base = index.view()
    if base.version:
        raise Conflict(f"{path} has an index")
    index._add(base, told(docs, key, text, vault), None)
    return index
