"""Sets of types and maps of tags; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _map(c: Column) -> Column:
    return F.coalesce(c, F.create_map())


def types_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(_array(a), _array(b)), F.lit(False))


def types_removed(before: Column, after: Column) -> Column:
    """Types that were there and aren't any more, sorted."""
    return F.array_sort(F.array_except(_array(before), _array(after)))


def types_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(_array(a), _array(b)))


def tags_remove(tags: Column, tag: str) -> Column:
    return F.map_filter(_map(tags), lambda k, _: k != tag)


def tags_put(tags: Column, tag: str, rev: Column) -> Column:
    """The tag points at this revision, wherever it pointed before."""
    return F.map_concat(tags_remove(tags, tag), F.create_map(F.lit(tag), rev))


def tags_merge(tags: Column, more: Column) -> Column:
    """All tags of both; of a tag in both, what more says counts."""
    return F.map_concat(F.map_filter(_map(tags), lambda k, _: ~F.map_contains_key(_map(more), k)), _map(more))
