"""Reusable column predicates: dynamic properties, paths, validity intervals, ordinal and age filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z0-9_]+){0,4}")
#: Rank of each confidence word; others rank 0.
CONFIDENCE = {"direct": 3, "inferred": 2, "uncertain": 1}


def json_path(field: str) -> str:
    """A validated JSON path: at most five parts, whole-number parts index arrays."""
    if not FIELD.fullmatch(field):
        raise ValueError(f"bad field path: {field!r}")
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in field.split("."))


def prop(props: Column | str, field: str) -> Column:
    """The property as text; null where it is missing or JSON null."""
    return F.get_json_object(props, json_path(field))


def typed(props: Column | str, field: str) -> Column:
    """The property as a variant, null where it is missing or JSON null: numbers, texts and booleans stay what they are."""
    value = F.try_variant_get(F.try_parse_json(props), json_path(field), "variant")
    return F.when(~F.is_variant_null(value), value)


def is_value(value: Column, want: Any) -> Column:
    """A variant that is the wanted value: a number never equals its text, nor true its word. Null for a null variant."""
    if isinstance(want, bool):
        return (F.schema_of_variant(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == want)
    if isinstance(want, int | float):
        number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return number & (F.try_variant_get(value, "$", "double") == float(want))
    return (F.schema_of_variant(value) == "STRING") & (F.try_variant_get(value, "$", "string") == str(want))


def once(value: Column, test: Callable[[Column], Column]) -> Column:
    """The test of a value that is worked out once, however often the test names it; false where it is null."""
    return F.exists(F.array(value), lambda v: F.coalesce(test(v), F.lit(False)))


def _condition(want: Any) -> Callable[[Column], Column]:
    """The test of a property, a variant, by one condition."""
    if want is None:
        return lambda v: v.isNull() | F.is_variant_null(v)
    if not isinstance(want, dict):
        return lambda v: is_value(v, want)
    (op, arg), = want.items()
    if op == "$in":
        return lambda v: reduce(lambda out, a: out | F.coalesce(is_value(v, a), F.lit(False)), arg or (), F.lit(False))
    if op == "$exists":
        there = lambda v: v.isNotNull() & ~F.is_variant_null(v)
        return there if arg else lambda v: ~there(v)
    if op == "$contains":
        none = F.array().cast("array<variant>")
        return lambda v: F.exists(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none), lambda x: F.coalesce(is_value(x, arg), F.lit(False)))
    raise ValueError(f"unknown operator {op}")


def match_props(props: str, where: dict[str, Any]) -> Column:
    """All conditions hold: a value (equality), None (missing or null), or one of $in, $exists and $contains. The properties are parsed once a row."""
    tests = [(json_path(field), _condition(want)) for field, want in where.items()]
    if not tests:
        return F.lit(True)
    held = lambda doc: reduce(lambda out, t: out & once(F.try_variant_get(doc, t[0], "variant"), t[1]), tests, F.lit(True))
    return once(F.try_parse_json(props), held)


def matches_text(props: str, field: str, want: str) -> Column:
    """The property, as text, is the wanted text, or an array that holds it; a missing or null one never matches."""

    def test(value: Column) -> Column:
        items = F.try_variant_get(value, "$", "array<string>")
        one = F.schema_of_variant(value).rlike("^(ARRAY|OBJECT)")
        return F.when(one, F.array_contains(items, want)).otherwise(F.try_variant_get(value, "$", "string") == want)

    return once(F.try_variant_get(F.try_parse_json(props), json_path(field), "variant"), test)


def strictly(props: str, want: dict[str, Any]) -> Column:
    """All given keys have just these values, of the same type; null asks for a null that is there."""
    out = F.lit(True)
    for field, value in want.items():
        held = F.try_variant_get(F.try_parse_json(props), json_path(field), "variant")
        out = out & F.coalesce(F.is_variant_null(held) if value is None else is_value(held, value), F.lit(False))
    return out


def glob_regex(glob: str) -> str:
    """** crosses folders, * and ? don't; a trailing /** also matches the folder itself."""
    tail = glob.endswith("/**")
    body = re.escape(glob[:-3] if tail else glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{body}{'(/.*)?' if tail else ''}$"


def matches_any_glob(path: Column, globs: Sequence[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def valid_at(start: str, end: str, at: Column, error: str | None = None) -> Column:
    """Half-open interval with open bounds where null; rows with a validity error are never valid."""
    ok = F.coalesce(F.col(start) <= at, F.lit(True)) & F.coalesce(F.col(end) > at, F.lit(True))
    return ok & F.col(error).isNull() if error else ok


def not_superseded(status: str = "status") -> Column:
    return F.col(status).isNull() | (F.col(status) != "superseded")


def confidence_rank(column: str) -> Column:
    out = F.lit(0)
    for word, rank in CONFIDENCE.items():
        out = F.when(F.col(column) == word, rank).otherwise(out)
    return out


def younger_than(column: str, days: float, now: Column) -> Column:
    age = (now.cast("double") - F.col(column).cast("timestamp").cast("double")) / 86400
    return F.coalesce(age <= days, F.lit(False))


def query_props(df: DataFrame, props: str, where: dict[str, Any], order: str, key: str, limit: int = 100) -> DataFrame:
    """Property filter with newest first and a clamped limit; rows without properties are left out, unless nothing is asked."""
    rows = df.filter(F.col(props).isNotNull() & match_props(props, where)) if where else df
    return rows.orderBy(F.desc(order), key).limit(max(1, min(1000, limit)))
