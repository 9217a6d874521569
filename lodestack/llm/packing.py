"""Operator 1, packing: best-fit decreasing with a segment tree over remaining capacities.

Every input partition is packed by its own task and nothing is shuffled: full windows of overlong documents leave at
once, tails wait in a bounded buffer. When the buffer is full, its tails are placed in decreasing size, each into the
tightest open window; windows with much room left stay open for the next buffer. At the end of the partition the
few windows with a gap are closed by cutting pieces of the emptiest ones, and the last of all is cut at powers of two,
at which no padding is due. Memory is bounded by the buffer, and no key can make a partition hot.

Cases: a null text is empty; an empty text has the end id alone; texts of any length are cut; repeated rows and ties are
packed once for each row; an empty table gives no pieces; columns of the input other than the two named are ignored, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestack.llm.common import by_bytes
from lodestack.llm.tokens import load

PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves are capacities and whose nodes count windows."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.at[capacity].append(window)
            self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """The window of least capacity that is at least `need`, taken out; None if there is none."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


class Packer:
    """Packs the tails of one partition; pieces are (document key, start, ids, document's tokens)."""

    def __init__(self, window: int, buffer: int, keep_open: int, min_fill: int, first_id: int):
        self.window, self.buffer, self.keep_open, self.min_fill = window, buffer, keep_open, min_fill
        self.next_id = first_id
        self.tails: list[tuple] = []
        self.open: list[list[tuple]] = []

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        total, full = len(ids), len(ids) // self.window * self.window
        for start in range(0, full, self.window):
            yield from self._close([(key, start, ids[start : start + self.window], total)])
        if full < total:
            self.tails.append((key, full, ids[full:].copy(), total))
            if len(self.tails) >= self.buffer:
                yield from self._pack()

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(last=True)

    def _close(self, window: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, start, ids, total in window:
            yield key, start, len(ids), total, self.next_id, at, ids
            at += len(ids)
        self.next_id += 1

    def _pack(self, last: bool = False) -> Iterator[tuple]:
        tree, windows = OpenWindows(self.window), self.open
        for i, pieces in enumerate(windows):
            tree.put(self.window - sum(len(p[2]) for p in pieces), i)
        for piece in sorted(self.tails, key=lambda p: -len(p[2])):
            need = len(piece[2])
            found = tree.tightest(need)
            if found is None:
                found = self.window, len(windows)
                windows.append([])
            room, i = found
            windows[i].append(piece)
            tree.put(room - need, i)
        self.tails, self.open = [], []
        gap = {i: self.window - sum(len(p[2]) for p in pieces) for i, pieces in enumerate(windows)}
        stay = [] if last else sorted((i for i in gap if gap[i] >= self.keep_open), key=lambda i: -gap[i])[: self.buffer // 4]
        staying = set(stay)
        ragged = []
        for i, pieces in enumerate(windows):
            if i in staying:
                self.open.append(pieces)
            elif last and gap[i] >= self.min_fill:
                ragged.append(pieces)
            else:
                yield from self._close(pieces)
        if ragged:
            yield from self._level(ragged)

    def _level(self, windows: list[list[tuple]]) -> Iterator[tuple]:
        """Close the gaps of the fuller windows with pieces cut from the emptiest; cut the last at powers of two."""
        filled = lambda w: sum(len(p[2]) for p in w)
        windows.sort(key=filled, reverse=True)
        while len(windows) > 1:
            room = self.window - filled(windows[0])
            if not room:
                yield from self._close(windows.pop(0))
                continue
            giver = windows[-1]
            key, start, ids, total = giver.pop()
            windows[0].append((key, start, ids[:room], total))
            if len(ids) > room:
                giver.append((key, start + room, ids[room:], total))
            if not giver:
                windows.pop()
        rest = windows[0]
        while rest:
            length = filled(rest)
            size = 1 << (length.bit_length() - 1)
            now: list[tuple] = []
            while size:
                key, start, ids, total = rest.pop(0)
                now.append((key, start, ids[:size], total))
                if len(ids) > size:
                    rest.insert(0, (key, start + size, ids[size:], total))
                size -= min(size, len(ids))
            yield from self._close(now)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = 1024,
    end_id: int = 0,
    buffer: int = 16384,
    keep_open: int = 16,
    min_fill: int = 8,
) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids: the id column, then PIECES (ids: little-endian uint32).

    A document is its text's ids and `end_id`. `buffer` bounds the tails a task holds; windows with `keep_open` or more
    ids of room wait for the next buffer; gaps under `min_fill` ids are left as padding rather than filled by cuts.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        packer = Packer(window, buffer, keep_open, min_fill, TaskContext.get().partitionId() << 40)
        schema = None
        rows: list[tuple] = []

        def emit() -> pa.RecordBatch:
            key, start, length, total, sequence, offset, ids = zip(*rows, strict=True)
            data = [pa.array(key, schema), *(pa.array(x, pa.int64()) for x in (start, length, total, sequence, offset))]
            blob = pa.array([x.tobytes() for x in ids], pa.binary())
            return pa.RecordBatch.from_arrays([*data, blob], names=[id_column, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in by_bytes(batches, text_column, 1 << 20):
            schema = batch.schema.field(id_column).type
            ids, offsets = encoder.encode(batch.column(text_column))
            ids = np.insert(ids, offsets[1:], end_id).astype("uint32")
            offsets = offsets + np.arange(len(offsets))
            for i, key in enumerate(batch.column(id_column).to_pylist()):
                rows.extend(packer.add(key, ids[offsets[i] : offsets[i + 1]]))
                if len(rows) >= 4096:
                    yield emit()
                    rows.clear()
        rows.extend(packer.finish())
        if rows:
            yield emit()

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, {PIECES}")
