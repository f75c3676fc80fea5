"""Property maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("set", "merge", "replace")


def update(old: Column, new: Column, mode: str) -> Column:
    """``set`` takes the new map, ``merge`` keeps existing keys, ``replace`` overwrites them."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "set":
        return new
    winner, loser = (old, new) if mode == "merge" else (new, old)
    return F.map_concat(
        winner, F.map_filter(loser, lambda k, v: ~F.map_contains_key(winner, k))
    )


def contains(props: Column, key: str) -> Column:
    return F.map_contains_key(props, key)


def get(props: Column, key: str) -> Column:
    return F.try_element_at(props, F.lit(key))


def unset(props: Column, keys) -> Column:
    return F.map_filter(props, lambda k, v: ~k.isin(list(keys)))


def equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
