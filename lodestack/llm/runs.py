"""Operator 12, periodic run detection: all maximal repetitions of words in each text, by the runs theorem.

A run is a stretch of words with smallest period q, at least `min_length` words and `min_repeats` periods long, which no
neighbouring word extends with that period. By the theorem each run holds a Lyndon root that is the longest Lyndon word at its
first place, under the order of words or under its reverse. So, for all texts of a batch at once and in numpy:

1. suffixes of each text are ranked by prefix doubling, where only suffixes not yet told apart are sorted again (the inverse suffix array);
2. the longest Lyndon word at each place ends at the next smaller value of that array; under the reverse order, at the next larger;
3. each such word is extended to both sides as far as its period holds, by longest common extensions: the minimum of the array of
   longest common prefixes between two suffixes, from a sparse table, of the text and of the reversed text. Words whose
   surroundings show by three comparisons that no run of the least length can hold them are left out before.

Texts are handled in batches of about a megabyte, whole texts always, so memory is bounded by that or by the longest text (some 500
bytes a word of it). Nothing is shuffled; a lost executor's batches are simply done again.

Cases: a null or empty text, or one of white space only, has no words and no runs, and its collapsed text is empty; repeated
rows and ids, and null ids, are judged row by row; other columns than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import by_bytes

#: A rewriting of a text's words, given its id and its words, before runs are looked for.
Rewrite = Callable[[object, list[bytes]], list[bytes]]


class Suffixes:
    """Ranks of the suffixes of several texts laid end to end, each closed by a 0 that no text holds. Ranks of a text's suffixes lie together."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray):
        self.n = n = len(symbols)
        self.symbols = symbols
        key = owner.astype("int64") * (int(symbols.max(initial=0)) + 1) + symbols
        order = np.argsort(key, kind="stable")
        key = key[order]
        slots = np.arange(n)
        head = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(head, slots, 0))
        rank = np.empty(n, "int64")
        rank[order] = first
        #: rank by the first 2**k symbols, for each k: equal values stand for equal pieces
        self.levels = [rank.astype("int32")]
        step = 1
        while True:
            same = first[1:] == first[:-1]
            open_ = np.zeros(len(slots), bool)
            open_[1:] |= same
            open_[:-1] |= same
            slots = slots[open_]
            if not len(slots):
                break
            place = order[slots]
            # Pieces that are still equal hold no closing 0, so what follows them is inside the text.
            key = first[open_] * (n + 1) + rank[place + step]
            turn = np.argsort(key, kind="stable")
            place, key = place[turn], key[turn]
            order[slots] = place
            head = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(head, slots, 0))
            rank[place] = first
            self.levels.append(rank.astype("int32"))
            step *= 2
        self.order, self.rank = order, rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b (other places of one text) have in common, by descent through the levels."""
        out = np.zeros(len(a), "int64")
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            out += (level[a + out] == level[b + out]).astype("int64") << k
        return out

    def extensions(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Longest common extensions of pairs of places of one text: least common prefix between their ranks."""
        lcp = np.zeros(self.n, "int64")
        alike = np.flatnonzero(self.levels[0][self.order[1:]] == self.levels[0][self.order[:-1]]) + 1
        lcp[alike] = self.common(self.order[alike - 1], self.order[alike])
        table = sparse(lcp.astype("int32"), np.minimum, self.n)

        def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
            k = np.frexp(high - low)[1] - 1
            out = np.zeros(len(a), "int64")
            for level in np.unique(k):
                at = np.flatnonzero(k == level)
                out[at] = np.minimum(table[level][low[at]], table[level][high[at] - (1 << int(level))])
            return out

        return between


def sparse(values: np.ndarray, least: np.ufunc, reach: int) -> list[np.ndarray]:
    """Rows of the least (or greatest) of 2**k values from each place on, for 2**k up to `reach`; windows beyond the end stop there."""
    table, k = [values], 1
    while k <= reach and k < len(values):
        last, row = table[-1], table[-1].copy()
        row[:-k] = least(last[:-k], last[k:])
        table.append(row)
        k *= 2
    return table


def next_smaller(values: np.ndarray, reach: int) -> np.ndarray:
    """For each place the next one with a smaller value, which must come within `reach` places; places without any get their own.

    Leaps of doubled length over windows of larger values, as long as they last, then of halved length.
    """
    n = len(values)
    table = sparse(values, np.minimum, reach)
    at = np.minimum(np.arange(1, n + 1), n - 1)
    going, stopped = np.arange(n - 1), []
    for k, row in enumerate(table):
        over = row[at[going]] > values[going]
        stopped.append(going[~over])
        going = going[over]
        at[going] = np.minimum(at[going] + (1 << k), n - 1)
    pool = going
    for k in range(len(table) - 1, -1, -1):
        over = pool[table[k][at[pool]] > values[pool]]
        at[over] = np.minimum(at[over] + (1 << k), n - 1)
        pool = np.concatenate([pool, stopped[k]]) if k else pool
    return at


def lyndon_ends(rank: np.ndarray, closing: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """Ends of the longest Lyndon words under the order and under its reverse; under the reverse a word that has no end stops at the closing place."""
    yield next_smaller(rank, reach)
    other = -rank
    other[closing] = -len(rank) - 1
    yield next_smaller(other, reach)


def find_runs(symbols: list[np.ndarray], min_length: int = 12, min_repeats: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length, period of all runs of the given sequences (of positive numbers), sorted by all of these."""
    none = np.zeros(0, "int64")
    sizes = np.array([len(s) for s in symbols], "int64")
    want = np.flatnonzero(sizes >= max(min_length, 2))
    if not len(want):
        return none, none, none, none
    flat, owner, begin = lay(symbols, want)
    closing = np.append(begin[1:], len(flat)) - 1
    reach = int(sizes[want].max()) + 1
    index = Suffixes(flat, owner)
    place, period = [], []
    here = np.arange(len(flat))
    for kind, end in enumerate(lyndon_ends(index.rank, closing, reach)):
        q = end - here
        fits = (flat > 0) & (q > 0) & (min_repeats * q <= sizes[want][owner])
        if kind:
            fits &= flat[end] > 0  # without a larger suffix no word ends here; runs that reach the end are found by the first order
        i = here[fits]
        q = q[fits]
        # What the extensions must bring together is at least this, so as many comparisons on one side must hold.
        least = np.maximum(min_length - q, (min_repeats - 1) * q)
        for k in range(3):
            need = np.minimum((least + 1) // 2, 3) > k
            ahead = np.minimum(i + k, len(flat) - 1)
            match = (flat[ahead] == flat[np.minimum(i + q + k, len(flat) - 1)]) & (flat[ahead] > 0)
            back = i - 1 - k
            match_back = (back >= 0) & (flat[np.maximum(back, 0)] == flat[i + q - 1 - k]) & (flat[np.maximum(back, 0)] > 0)
            if k == 0:
                right, left = match | ~need, match_back | ~need
            else:
                right, left = right & (match | ~need), left & (match_back | ~need)
        keep = right | left
        place.append(i[keep])
        period.append(q[keep])
    place, period = np.concatenate(place), np.concatenate(period)
    if not len(place):
        return none, none, none, none
    # Only texts that may hold a run get the tables for extensions, of themselves and reversed.
    some = np.unique(owner[place])
    flat2, owner2, begin2 = lay(symbols, want[some])
    spot = np.searchsorted(some, owner[place])
    size = sizes[want[some]][spot]
    inner = place - begin[some[spot]]
    here = begin2[spot] + inner
    right = Suffixes(flat2, owner2).extensions()(here, here + period)
    back, owner3, begin3 = lay([s[::-1] for s in (symbols[k] for k in want[some].tolist())], np.arange(len(some)))
    mirror = begin3[spot] + size - 1 - (inner - 1)  # the place before the word, read backwards; the closing 0 for none
    left = np.where(inner > 0, Suffixes(back, owner3).extensions()(mirror, mirror - period), 0)
    start, length = inner - left, left + period + right
    good = (length >= min_length) & (length >= min_repeats * period)
    rows = np.unique(np.stack([want[some[spot]], start, period, length], axis=1)[good], axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 2]


def lay(symbols: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen sequences end to end, each closed by 0; the number of each symbol's sequence; where each begins."""
    size = np.array([len(symbols[k]) + 1 for k in which.tolist()], "int64")
    end = np.zeros(1, "int64")
    flat = np.concatenate([x for k in which.tolist() for x in (symbols[k], end)])
    return flat, np.repeat(np.arange(len(which)), size), np.cumsum(size) - size


def numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Each word by a number over 0, equal words by equal ones."""
    known: dict[bytes, int] = {}
    total = sum(map(len, texts))
    flat = np.fromiter(map(known.setdefault, chain.from_iterable(texts), count(1)), "int64", total)
    return np.split(flat, np.cumsum([len(t) for t in texts])[:-1]) if texts else []


def collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(start):
        return words
    change = np.zeros(len(words) + 1, "int64")
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_length: int = 12, min_repeats: int = 2, rewrite: Rewrite | None = None, batch_bytes: int = 1 << 20) -> DataFrame:
    """The id, n_words, runs (an array of start, length, period, by start and period) and the collapsed text of every row.

    Words are bytes other than ASCII white space and are numbered from 0. `collapsed` joins by one space the words that no run
    holds after its first period. `rewrite` may change a text's words before.
    """
    if min_repeats < 2:
        raise ValueError("a run has two periods at least")
    kind = docs.schema[id_column].dataType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "run_text", batch_bytes):
            ids = batch.column(0)
            # bytes.split parts at exactly the six white-space bytes of ASCII.
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            if rewrite:
                texts = [rewrite(i, t) for i, t in zip(ids.to_pylist(), texts, strict=True)]
            text, start, length, period = find_runs(numbered(texts), min_length, min_repeats)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            kept = [b" ".join(collapse(t, start[a:b], length[a:b], period[a:b])) for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True)]
            items = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(runs_type.value_type))
            found = pa.ListArray.from_arrays(pa.array(cuts.astype("int32")), items).cast(runs_type)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, sizes, found, pa.array(kept, pa.binary()).cast(pa.string())], names=[id_column, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_column), F.col(text_column).cast("binary").alias("run_text"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
