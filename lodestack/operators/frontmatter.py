"""Edits of properties and bodies: directives that set, unset, push and pull, and patches of one section."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions import text as md
from lodestack.functions.hashing import canonical_json

EDIT = "struct<props: string, diff: array<struct<key: string, op: string, before: string, after: string>>>"
PATCH = "struct<body: string, error: string>"
_GONE = object()


def edit(props: dict, merge: dict[str, Any]) -> tuple[dict, list[tuple[str, str, Any, Any]]]:
    """Properties after the merge, and (key, op, before, after) of each key that changed; _GONE is no value.

    {"$unset": ...} takes a key out, {"$push": v} appends to a list (or starts one), {"$pull": v} takes equal items out, an object
    is laid over an object, anything else is the new value. Values are equal as JSON, so 1 is not true.
    """
    same = lambda a, b: a is not _GONE and b is not _GONE and canonical_json(a) == canonical_json(b)
    now, diff = dict(props), []
    for key, wanted in merge.items():
        before = now.get(key, _GONE)
        op, after = "set", wanted
        if isinstance(wanted, dict) and "$unset" in wanted:
            op, after = "unset", _GONE
        elif isinstance(wanted, dict) and "$push" in wanted:
            op, after = "push", [*(before if isinstance(before, list) else []), wanted["$push"]]
        elif isinstance(wanted, dict) and "$pull" in wanted:
            op, after = "pull", [x for x in before if not same(x, wanted["$pull"])] if isinstance(before, list) else before
        elif isinstance(wanted, dict) and isinstance(before, dict):
            after = before | wanted
        if before is after or same(before, after):
            continue
        if after is _GONE:
            del now[key]
        else:
            now[key] = after
        diff.append((key, op, before, after))
    return now, diff


def edited(props: str, merge: dict[str, Any]) -> Column:
    """EDIT of a JSON column: what can't be read counts as no properties. Values in the diff are JSON, null where there is none."""
    told = lambda v: None if v is _GONE else canonical_json(v)

    def one(text: str | None) -> dict:
        try:
            held = json.loads(text) if text else {}
        except ValueError:
            held = {}
        now, diff = edit(held if isinstance(held, dict) else {}, merge)
        return {"props": canonical_json(now), "diff": [{"key": k, "op": op, "before": told(a), "after": told(b)} for k, op, a, b in diff]}

    return F.pandas_udf(lambda s: pd.DataFrame([one(t) for t in s], columns=["props", "diff"]), EDIT)(props)


def patch_section(body: str, path: list[str], content: str) -> tuple[str, str | None]:
    """(body, error): what stands below the one heading of that path, up to the next of its level or above, becomes the content."""
    if not path or not all(path):
        return body, "invalid_patch"
    heads, paths = md.headings(body), md.heading_paths(body)
    found = [i for i, (_, p) in enumerate(paths) if p == path]
    if len(found) != 1:
        return body, "ambiguous_target" if found else "target_not_found"
    at, level, _ = heads[found[0]]
    line_end = body.find("\n", at)
    start = len(body) if line_end < 0 else line_end + 1
    end = next((a for a, other, _ in heads[found[0] + 1 :] if other <= level), len(body))
    newline = "\r\n" if "\r\n" in body else "\n"
    new = content.replace("\r\n", "\n").replace("\n", newline)
    if new and end < len(body) and not new.endswith(newline):
        new += newline
    if new and start == len(body) and not body.endswith("\n"):
        new = newline + new
    return body[:start] + new + body[end:], None


def patched(body: str, path: list[str], content: str) -> Column:
    """PATCH of a text column; a null body is empty."""
    return F.pandas_udf(lambda s: pd.DataFrame([patch_section(t or "", path, content) for t in s], columns=["body", "error"]), PATCH)(body)
