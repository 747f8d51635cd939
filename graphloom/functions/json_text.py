"""JSON functions. Those of fixed depth are native; those that walk nested values are Arrow-batched."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_is_empty(text: Column) -> Column:
    """An empty object, array or text."""
    return F.regexp_replace(text, r"\s", "").isin("{}", "[]", '""')


def json_unwrap_single(text: Column) -> Column:
    """The element of an array of one; other values as they are."""
    array = F.from_json(text, "array<variant>")
    return F.when(text.startswith("[") & (F.size(array) == 1), F.to_json(F.element_at(array, 1))).otherwise(text)


def json_add_if_exists(text: Column, key: str, value: Column) -> Column:
    """A key added to an object's end, unless the value is null."""
    pair = F.concat(F.lit(f'"{key}":'), value)
    return F.when(value.isNull(), text).when(json_is_empty(text), F.concat(F.lit("{"), pair, F.lit("}"))).otherwise(F.concat(F.regexp_replace(text, r"\}\s*$", ","), pair, F.lit("}")))


def json_add_if_non_empty(text: Column, key: str, value: Column) -> Column:
    """A key added to an object's end, unless the value is null or empty."""
    return json_add_if_exists(text, key, F.when(~json_is_empty(value), value))


def _dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _mapped(fn: Callable) -> Callable[[Column], Column]:
    """A column function from one on parsed values; what isn't JSON becomes null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return _dumps(fn(json.loads(text)))
            except (TypeError, ValueError, RecursionError):
                return None

        return texts.map(one)

    return run


def _walk(value, visit: Callable):
    """Rebuild a value bottom-up; visit gets every object's items and gives new ones."""
    if isinstance(value, dict):
        return dict(visit([(k, _walk(v, visit)) for k, v in value.items()]))
    if isinstance(value, list):
        return [_walk(v, visit) for v in value]
    return value


def json_remove_keys(text: Column, *keys: str) -> Column:
    """Top-level keys removed."""
    return _mapped(lambda v: {k: x for k, x in v.items() if k not in keys} if isinstance(v, dict) else v)(text)


def json_remove_metadata_keys(text: Column) -> Column:
    """Top-level keys that start with _ removed."""
    return _mapped(lambda v: {k: x for k, x in v.items() if not k.startswith("_")} if isinstance(v, dict) else v)(text)


def json_remove_all(text: Column, keys: tuple[str, ...] = (), values: tuple = (), pairs: tuple[tuple, ...] = ()) -> Column:
    """Keys, values and key-value pairs removed at any depth."""
    return _mapped(lambda v: _walk(v, lambda items: [(k, x) for k, x in items if k not in keys and x not in values and (k, x) not in pairs]))(text)


def json_replace(text: Column, key: str | None, old, new) -> Column:
    """A value replaced at any depth, under one key or any."""
    return _mapped(lambda v: _walk(v, lambda items: [(k, new if x == old and (key is None or k == key) else x) for k, x in items]))(text)


def json_map_all_keys(text: Column, key: str, fn: Callable) -> Column:
    """The values of a key at any depth, changed by a function."""
    return _mapped(lambda v: _walk(v, lambda items: [(k, fn(x) if k == key else x) for k, x in items]))(text)


def json_sort_keys(text: Column) -> Column:
    return _mapped(lambda v: _walk(v, sorted))(text)


def json_extract_values(text: Column, *keys: str) -> Column:
    """The distinct values of keys at any depth, as a sorted JSON array."""

    def find(v):
        found = set()
        _walk(v, lambda items: [found.add(_dumps(x)) or (k, x) if k in keys else (k, x) for k, x in items])
        return [json.loads(x) for x in sorted(found)]

    return _mapped(find)(text)


def json_deep_merge(left: Column, right: Column) -> Column:
    """Objects merged key by key at any depth; where both have a value the right one wins."""

    def merge(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            return a | {k: merge(a[k], x) if k in a else x for k, x in b.items()}
        return b

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return _dumps(merge(json.loads(x), json.loads(y)))
            except (TypeError, ValueError, RecursionError):
                return None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return run(left, right)
