"""Content hashes: stable identities of documents, chunks, sections and imports."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """JSON with sorted keys on every level and without spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def note_hash(content: str, properties: dict | None) -> str:
    return digest(content + canonical_json(properties or {}))


def chunk_fragment(text: str) -> str:
    """First seven hex digits over the text with LF ends, trimmed at the right, in NFC."""
    return digest(unicodedata.normalize("NFC", text.replace("\r\n", "\n").rstrip()))[:7]


def chunk_ids(document: Column, text: Column) -> Column:
    """Ids of chunks that follow their content: the document's handle and the text's fragment; null for a null text."""
    return F.concat(document, F.lit("#chunk-"), F.arrow_udf(one_by_one(lambda t: None if t is None else chunk_fragment(t)), "string")(text))


def one_by_one(run: Callable[[str | None], str | None], rows: int = 64) -> Callable[[pa.Array], pa.Array]:
    """For arrow_udf: the function over a column of texts, of which only `rows` at a time are Python objects."""

    def each(texts: pa.Array) -> pa.Array:
        parts = [pa.array([run(t) for t in texts.slice(at, rows).to_pylist()], pa.string()) for at in range(0, len(texts), rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return each


def section_anchor(heading: str, body: str) -> str:
    """Over the heading and the section's own text (up to the next heading, without its last line end), both in NFC."""
    return digest("\n".join(unicodedata.normalize("NFC", x) for x in (heading, body.removesuffix("\n"))))


def import_identity(provider: Column, external_id: Column) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', "\\\\$1"), F.lit('"'))
    return F.sha2(F.concat(F.lit("["), quoted(provider), F.lit(","), quoted(external_id), F.lit("]")), 256)
