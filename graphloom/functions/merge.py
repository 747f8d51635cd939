"""Deep merging of JSON texts in the JVM, by variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT, ARRAY = "map<string,variant>", "array<variant>"
#: Objects within objects that are merged key by key; of deeper ones the right one counts whole.
DEPTH = 5
#: Objects and arrays within one another that a key is taken out of: an expression grows with two to this power.
KEY_DEPTH = 4


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", OBJECT)


def _written(members: Column) -> Column:
    """A JSON object's text from an array of (key, value), values as texts."""
    key = lambda e: F.regexp_extract(F.to_json(F.array(e["key"])), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda e: F.concat(key(e), F.lit(":"), e["value"])), ","), F.lit("}"))


def merged(left: Column, right: Column, depth: int = DEPTH) -> Column:
    """The text of two variants merged: objects key by key, of anything else the right one."""
    if depth == 0:
        return F.to_json(right)
    both = F.map_zip_with(_object(left), _object(right), lambda k, x, y: F.when(x.isNull(), F.to_json(y)).when(y.isNull(), F.to_json(x)).otherwise(merged(x, y, depth - 1)))
    return F.when(_object(left).isNotNull() & _object(right).isNotNull(), _written(F.map_entries(both))).otherwise(F.to_json(right))


def without_key(v: Column, key: str, depth: int = KEY_DEPTH) -> Column:
    """The text of a variant without a key, in objects within objects and arrays as deep as KEY_DEPTH."""
    if depth == 0:
        return F.to_json(v)
    kept = F.transform(F.filter(F.map_entries(_object(v)), lambda e: e["key"] != key), lambda e: F.struct(e["key"].alias("key"), without_key(e["value"], key, depth - 1).alias("value")))
    items = F.transform(F.try_variant_get(v, "$", ARRAY), lambda x: without_key(x, key, depth - 1))
    return F.when(_object(v).isNotNull(), _written(kept)).when(items.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(F.to_json(v))


def is_blank(v: Column) -> Column:
    """Null, an empty object or array, or not JSON."""
    return v.isNull() | F.to_json(v).isin("{}", "[]", "null", '""')


def deep_merge(left: Column, right: Column) -> Column:
    """Two JSON texts as one, keys sorted; where one is empty or no JSON, the other."""
    a, b = F.try_parse_json(left), F.try_parse_json(right)
    return F.when(is_blank(a), F.to_json(b)).when(is_blank(b), F.to_json(a)).otherwise(F.to_json(F.try_parse_json(merged(a, b))))
