"""Exact and fast encoding with the tokenizers library, one Arrow batch at a time.

A text is cut into units where no pre-token of the two supported kinds of tokenizer can cross: before a single space
and around a single newline between characters that are no white space, and between ASCII letters and punctuation. So
the ids of a text are those of its units in order. Distinct units are encoded by the library once and kept in a
bounded cache; ids are then gathered with numpy. Tokenizers of another kind encode whole texts by the library, as are texts
that hold the string of a special token, which the library gives that token's id.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestack.llm.common import flat_text

LETTER, PUNCT, SPACE = (np.zeros(256, bool) for _ in range(3))
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True
PUNCT[33:127] = ~LETTER[33:127]
PUNCT[ord("0") : ord("9") + 1] = False
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes that can follow a cut: ASCII without white space, and lead bytes of characters that hold no white space.
SOLID_START = ~SPACE
SOLID_START[0x80:0xC3] = False
SOLID_START[[0xE1, 0xE2, 0xE3]] = False
_LOADED: dict[str, UnitTokenizer] = {}
#: Stands after each unit where several are encoded in one call; white space around it keeps it a pre-token of its own.
#: Where a tokenizer makes several ids of it, the string of a special token is the mark, which no unit holds.
MARK, TOGETHER = " \x01 ", 64


class _Units:
    """Ids of the units seen so far, in one flat array."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, "uint32"), np.zeros(1 << 14, "int64")
        self.again = np.zeros(1 << 14, bool)
        self.n = 0

    def trim(self) -> None:
        """Keep the units that were found again since the last time, if they fill half of the room at most."""
        again, ends = self.again[: self.n], self.ends[: self.n]
        stay, sizes = np.flatnonzero(again), np.diff(ends, prepend=0)
        if not 0 < len(stay) <= self.limit // 2 or sizes[stay].sum() > 8 * self.limit:
            return self.clear()
        kept = self.flat[: ends[-1]][np.repeat(again, sizes)]
        names = [unit for unit, keeps in zip(self.at, again.tolist(), strict=True) if keeps]
        self.at = dict(zip(names, range(len(names)), strict=True))
        self.flat = np.concatenate([kept, np.zeros(1 << 16, "uint32")])
        self.ends = np.concatenate([np.cumsum(sizes[stay]), np.zeros(1 << 14, "int64")])
        self.again = np.zeros(len(self.ends), bool)
        self.n = len(names)

    def find(self, units: list[str]) -> np.ndarray:
        """Numbers of these units, which are distinct."""
        if len(self.at) > self.limit or self.n and self.ends[self.n - 1] > 16 * self.limit:
            self.trim()
        found = np.fromiter(map(self.at.get, units, repeat(-1)), "int64", len(units))
        missing = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(missing):
            fresh = [units[i] for i in missing.tolist()]
            ids, sizes = self.encode(fresh)
            size = int(self.ends[self.n - 1]) if self.n else 0
            while size + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.n + len(fresh) > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
                self.again = np.concatenate([self.again, np.zeros_like(self.again)])
            self.flat[size : size + len(ids)] = ids
            self.ends[self.n : self.n + len(fresh)] = size + np.cumsum(sizes)
            found[missing] = np.arange(self.n, self.n + len(fresh))
            self.at.update(zip(fresh, range(self.n, self.n + len(fresh)), strict=True))
            self.n += len(fresh)
        return found


class UnitTokenizer:
    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [x["content"] for x in spec["added_tokens"]]
        # Normalized ones are looked for in what the normalizer makes of a text, so the text itself can't tell.
        self.cuts = self._cuts_are_safe(spec) and not any(x["normalized"] for x in spec["added_tokens"])
        self.mark, self.mark_id = self._mark(spec["added_tokens"]) if self.cuts else (None, None)
        self.units = _Units(self.several, limit)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def several(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units and how many each has. Many are encoded in one call, and parted again by the mark's id; where a
        unit holds the mark itself there are more marks than units, and each is encoded alone."""
        if self.mark is not None:
            joined = [self.mark.join([*units[i : i + TOGETHER], ""]) for i in range(0, len(units), TOGETHER)]
            flat, _ = _flat(self.whole(joined), len(joined))
            marks = flat == self.mark_id
            at = np.flatnonzero(marks)
            if len(at) == len(units):
                return flat[~marks], np.diff(at, prepend=-1) - 1
        flat, offsets = _flat(self.whole(units), len(units))
        return flat, np.diff(offsets)

    def _mark(self, added: list[dict]) -> tuple[str | None, int | None]:
        """A mark and its id: one that this tokenizer makes one id of, and that leaves its neighbours as they are."""
        plain = [x["content"] for x in added if x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"])]
        # What a unit ends or starts with must not make a special token with a part of the mark.
        meets = lambda a, b: any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b) + 1)))
        apart = [x for x in plain if not any(meets(y, x) or meets(x, y) for y in self.specials)]
        for mark in (MARK, *apart):
            a, b, marked, both = self.whole(["a", "b", mark, f"a{mark}b"])
            if len(marked) == 1 and both == a + marked + b:
                return mark, marked[0]
        return None, None

    @staticmethod
    def _cuts_are_safe(spec: dict) -> bool:
        before = spec.get("pre_tokenizer") or {}
        if spec["normalizer"] is None and before.get("type") == "ByteLevel":
            return before["use_regex"] and not before["add_prefix_space"]
        split = (before.get("pretokenizers") or [{}])[0]
        kinds = {x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])}
        return split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and kinds <= {"NFC", "Replace", "Lowercase"}

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32 and the offsets of each text (len(text) + 1); a null text has none."""
        if not self.cuts:
            return _flat(self.whole(pc.fill_null(text, "").to_pylist()), len(text))
        special = np.zeros(len(text), bool)
        for content in self.specials:
            special |= pc.fill_null(pc.match_substring(text, content), False).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._from_units(text)
        mask = pa.array(special)
        ids, at = self._from_units(pc.if_else(mask, pa.scalar(None, text.type), text))
        whole, whole_at = _flat(self.whole(text.filter(mask).to_pylist()), int(special.sum()))
        sizes = np.diff(at)
        sizes[special] = np.diff(whole_at)
        out, owner = np.empty(len(ids) + len(whole), "uint32"), np.repeat(special, sizes)
        out[owner], out[~owner] = whole, ids
        return out, np.concatenate([[0], np.cumsum(sizes)])

    def _from_units(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = flat_text(text)
        if not len(data):
            return np.zeros(0, "uint32"), np.zeros(len(text) + 1, "int64")
        at = _cut(data, bounds)
        offsets = np.append(at, len(data)).astype("int32")
        units = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pc.dictionary_encode(units)
        found = self.units.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        ends = self.units.ends[found]
        starts = np.where(found > 0, self.units.ends[found - 1], 0)
        sizes = ends - starts
        upto = np.concatenate([[0], np.cumsum(sizes)])
        gather = np.repeat(starts - upto[:-1], sizes)
        gather += np.arange(upto[-1])
        return self.units.flat[gather], upto[np.searchsorted(at, bounds)]


def _cut(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Offsets at which units start: the first byte of each text that isn't empty, and every safe cut."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        prev, here, nxt = data[:-2], data[1:-1], data[2:]
        # The character before: ASCII without white space, or of two bytes from U+00C0 on, of which none is white space.
        solid_end = (prev < 0x80) & ~SPACE[prev]
        solid_end[1:] |= (prev[1:] >= 0x80) & (data[:-3] >= 0xC3) & (data[:-3] < 0xE0)
        alone = solid_end & SOLID_START[nxt]
        newline = alone & (here == 10)
        cut[1 : n - 1] = (alone & (here == 32)) | newline
        cut[2:n] |= newline
    if n > 1:
        left, right = data[:-1], data[1:]
        cut[1:n] |= (LETTER[left] & PUNCT[right]) | (PUNCT[left] & (left != ord("'")) & LETTER[right])
    cut[bounds] = True
    cut[n] = False
    return np.flatnonzero(cut)


def _flat(ids: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(n + 1, "int64")
    np.cumsum(np.fromiter((len(x) for x in ids), "int64", n), out=offsets[1:])
    return np.fromiter(chain.from_iterable(ids), "uint32", int(offsets[-1])), offsets


def load(path: str) -> UnitTokenizer:
    """One tokenizer a worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = UnitTokenizer(path)
    return _LOADED[path]
