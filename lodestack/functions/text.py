"""Markdown text functions: headings, chunks, links, list items, statements and relations. Plain Python, applied in Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a chunk and of the overlap, and the least characters of a chunk.
MAX_TOKENS, OVERLAP_TOKENS, MIN_CHARS = 400, 50, 3
#: Fences of these languages hold views that are computed; what stands for one, and the longest slug.
DYNAMIC = ("datacore", "datacorejsx", "datacorejs", "dataview", "dataviewjs")
PLACEHOLDER, SLUG = "[Datacore view]", 60
CHUNK = "array<struct<start: int, end: int, heading: string, body: string>>"
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
WIKILINK = re.compile(r"(?<!!)\[\[([^\[\]|#\n]*)(?:#([^\[\]|\n]*))?(?:\|([^\[\]\n]*))?\]\]")
BULLET = re.compile(r"^( *)[-*+][ \t]+(.*)$")
CATEGORY = re.compile(r"\[([a-z][a-z0-9_-]*)\][ \t]+(.+)", re.S)
ROLE = re.compile(r"([a-z][a-z0-9_]*) \[\[([^\]|]+)(?:\|[^\]]+)?\]\]")
SENTENCE_END = re.compile(r"[.!?]\s+(?=[A-ZÄÖÜ])")
PARAGRAPH_END = re.compile(r"\n{2,}")
ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.\d{1,3})?(Z|[+-]\d\d:\d\d)")


def heading_of(line: str) -> tuple[int, str] | None:
    """(level, title) of an ATX heading: up to three spaces, one to six marks, a blank, the title, and marks that close it."""
    bare = line.lstrip(" ")
    title = bare.lstrip("#")
    level = len(bare) - len(title)
    if len(line) - len(bare) > 3 or not 1 <= level <= 6 or (title and title[0] not in " \t"):
        return None
    title = title.strip()
    inner = title.rstrip("#")
    return level, inner.rstrip() if not inner or inner[-1] in " \t" else title


def lines_outside_code(text: str) -> Iterator[tuple[int, int, str]]:
    """(line number, offset, line) of the lines that stand in no fence."""
    at, fence = 0, None
    for number, line in enumerate(text.split("\n")):
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
        elif mark:
            fence = mark[1]
        else:
            yield number, at, line
        at += len(line) + 1


def headings(text: str) -> list[tuple[int, int, str]]:
    """(offset, level, title) of each ATX heading outside code."""
    return [(at, *found) for _, at, line in lines_outside_code(text) if (found := heading_of(line))]


def heading_paths(text: str) -> list[tuple[int, list[str]]]:
    out, stack = [], []
    for at, level, title in headings(text):
        stack = [x for x in stack if x[0] < level] + [(level, title)]
        out.append((at, [t for _, t in stack]))
    return out


def wikilinks(text: str) -> list[dict]:
    out = []
    for number, _, line in lines_outside_code(text):
        plain = re.sub(r"`[^`]*`", lambda m: " " * len(m[0]), line)
        out += [{"target": m[1].strip(), "anchor": m[2], "alias": m[3], "line": number + 1} for m in WIKILINK.finditer(plain) if m[1].strip()]
    return out


def list_items(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the bullets outside code, with the lines below that are indented more than the mark."""
    out: list[list] = []
    indent, before = None, 0
    for number, _, line in lines_outside_code(text):
        found = BULLET.match(line)
        if found:
            out.append([number + 1, number + 1, found[2].strip()])
            indent = len(found[1])
        elif indent is not None and number == before + 1 and line.strip() and len(line) - len(line.lstrip(" ")) > indent:
            out[-1][1], out[-1][2] = number + 1, f"{out[-1][2]}\n{line.strip()}"
        else:
            indent = None
        before = number
    return [tuple(x) for x in out]


def instant(value: object) -> int | None:
    """Milliseconds of a strict date and time with a zone, else None."""
    found = ISO.fullmatch(value) if isinstance(value, str) else None
    if not found:
        return None
    import datetime as dt

    try:
        return round(dt.datetime.fromisoformat(value.replace("Z", "+00:00")).timestamp() * 1000)
    except ValueError:
        return None


def validity(properties: dict) -> tuple[int | None, int | None, str | None]:
    """(from, to, error) of valid_from and valid_to: the error is the key that can't be read, or valid_to where it isn't later."""
    bounds = []
    for key in ("valid_from", "valid_to"):
        value = properties.get(key)
        bounds.append(instant(value))
        if value is not None and bounds[-1] is None:
            return None, None, key
    start, end = bounds
    return (None, None, "valid_to") if start is not None and end is not None and start >= end else (start, end, None)


def statements(text: str) -> list[tuple]:
    """(first line, last line, category, text, from, to, error) of the bullets `[category] text`, but for ticked tasks; a comment
    `<!-- validity: {...} -->` at the end, outside code, gives the bounds."""
    out = []
    for first, last, item in list_items(text):
        found = CATEGORY.fullmatch(item)
        if not found or found[1] == "x":
            continue
        said, told = found[2].strip(), (None, None, None)
        mark = said.rfind("<!-- validity:")
        if mark >= 0 and said[:mark].count("`") % 2 == 0 and not said[mark:].partition("-->")[2].strip():
            try:
                value = json.loads(said[mark + len("<!-- validity:") :].strip().removesuffix("-->"))
                told = validity(value) if isinstance(value, dict) and value.keys() <= {"valid_from", "valid_to"} else (None, None, "annotation")
            except ValueError:
                told = (None, None, "annotation")
            said = said[:mark].strip()
        if said:
            out.append((first, last, found[1], said, *told))
    return out


def relations(text: str) -> list[tuple[str, str, int]]:
    """(role, target, line) of the whole bullets `role [[target]]` in sections headed "Relations"."""
    marks = [(text.count("\n", 0, at) + 1, path[-1] == "Relations") for at, path in heading_paths(text)]
    out = []
    for first, _, item in list_items(text):
        inside = [told for line, told in marks if line <= first]
        found = ROLE.fullmatch(item)
        if found and inside and inside[-1] and found[2].strip():
            out.append((found[1], found[2].strip(), first))
    return out


def without_views(text: str) -> tuple[str, int]:
    """The text with a placeholder for each fence that holds a computed view, and how many; one that isn't closed runs to the end."""
    out, views = [], 0
    mark, hidden = "", False
    for line in text.split("\n"):
        bare = line.strip()
        run = bare[: len(bare) - len(bare.lstrip(bare[:1]))] if bare[:1] in ("`", "~") else ""
        info = bare[len(run) :].strip()
        if mark:
            closes = run[:1] == mark[0] and len(run) >= len(mark) and not info
            if not hidden:
                out.append(line)
            if closes:
                mark, hidden = "", False
            continue
        if len(run) >= 3 and re.fullmatch(r"[\w-]*", info, re.A):
            mark, hidden = run, info.lower() in DYNAMIC
            views += hidden
            out.append(line[: len(line) - len(line.lstrip())] + PLACEHOLDER if hidden else line)
        else:
            out.append(line)
    return ("\n".join(out), views) if views else (text, 0)


def slug(claim: str) -> str:
    """Lower-case ASCII letters and digits with single hyphens between, without marks of accents, of bounded length."""
    bare = "".join(c for c in unicodedata.normalize("NFD", claim) if not "\u0300" <= c <= "\u036f").lower()
    return re.sub(r"[^a-z0-9]+", "-", bare).strip("-")[:SLUG].rstrip("-") or "observation"


def aliases(value: object) -> list[str]:
    """A text, or the texts of a list; anything else is no alias."""
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, str)]


def tokens(length: int) -> int:
    return -(-length // 4)


def _paragraphs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What stands between blank lines; the blank lines belong to none."""
    at = start
    for gap in PARAGRAPH_END.finditer(text, start, end):
        if gap.start() > at:
            yield at, gap.start()
        at = gap.end()
    if at < end:
        yield at, end


def _sentences(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    ends = [start + m.end() for m in SENTENCE_END.finditer(text[start:end])]
    yield from ((a, b) for a, b in zip([start, *ends], [*ends, end], strict=True) if a < b)


def _fit(text: str, start: int, end: int, size: int, finer: tuple[Callable, ...] = (_paragraphs, _sentences)) -> Iterator[tuple[int, int]]:
    """Spans of at most `size`: as many neighbouring paragraphs as fit, of one that doesn't as many sentences, else plain cuts."""
    if end - start <= size:
        yield start, end
        return
    if not finer:
        yield from ((a, min(end, a + size)) for a in range(start, end, size))
        return
    held: tuple[int, int] | None = None
    for a, b in list(finer[0](text, start, end)) or [(start, end)]:
        if held and b - held[0] <= size:
            held = held[0], b
            continue
        if held:
            yield from _fit(text, *held, size, finer[1:])
        held = a, b
    if held:
        yield from _fit(text, *held, size, finer[1:])


def chunks(text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int, str]]:
    """(start, end, heading): the whole text if it fits, else parts at headings of levels 1 to 3, each cut to fit.

    A part that isn't the first starts earlier by up to `overlap` tokens: behind the last sentence that ends there, or by all of
    them. The heading, with its marks, is the last before the part itself, of any level. Parts of fewer than three characters go.
    """
    found = headings(text)
    title = lambda at: next((f"{'#' * level} {name}" for place, level, name in reversed(found) if place <= at), "")
    if tokens(len(text)) <= most:
        return [(0, len(text), title(0))] if len(text.strip()) >= MIN_CHARS else []
    edges = sorted({0, len(text)} | {at for at, level, _ in found if level <= 3})
    spans = [span for a, b in zip(edges[:-1], edges[1:], strict=True) for span in _fit(text, a, b, most * 4)]
    out = []
    for i, (start, end) in enumerate(spans):
        first = start
        if i and overlap:
            first = max(0, start - overlap * 4)
            ends = [m.end() for m in SENTENCE_END.finditer(text[first:start])]
            first += ends[-1] if ends else 0
        if len(text[first:end].strip()) >= MIN_CHARS:
            out.append((first, end, title(start)))
    return out


def chunks_udf(column: str) -> Column:
    """The text's chunks as an array, in one Arrow call a batch."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "heading": h, "body": t[a:b]} for a, b, h in chunks(t or "")])

    return F.pandas_udf(run, CHUNK)(column)


def extracted(column: str, kind: str) -> Column:
    """List items, statements or relations of the text as an array of structs, in one Arrow call a batch."""
    fields, find = {
        "items": ("first: int, last: int, text: string", list_items),
        "statements": ("first: int, last: int, category: string, text: string, valid_from: bigint, valid_to: bigint, error: string", statements),
        "relations": ("role: string, target: string, line: int", relations),
    }[kind]
    names = [f.split(":")[0] for f in fields.split(", ")]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(names, row, strict=True)) for row in find(t or "")])

    return F.pandas_udf(run, f"array<struct<{fields}>>")(column)
