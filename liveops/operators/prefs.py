"""Stored preferences and the preferred device of a role."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, replace: bool) -> DataFrame:
    """Entries after storing ``new``, with what became of each.

    ``replace`` lets new entries win, otherwise existing ones stay; an entry
    equal to the stored one is not written.
    """
    fields = [c for c in old.columns if c != key]
    before = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in fields], F.lit(True).alias("_old"))
    after = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_new"))
    both = before.join(after, key, "full_outer")
    same = reduce(and_, [F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")) for c in fields])
    added = F.col("_old").isNull()
    take = added | (F.col("_new").isNotNull() & ~same & F.lit(replace))
    action = F.when(added, "add").when(take, "replace").otherwise("keep")
    return both.select(
        key,
        *[F.when(take, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in fields],
        action.alias("action"),
    )


def preferred(devices: DataFrame, roles: dict[str, str], by: str,
              exclude: int | None = None) -> DataFrame:
    """Available device with the least priority number per group and role, ties by device.

    ``roles`` maps a role to its priority column.
    """
    ready = devices.where("available")
    if exclude is not None:
        ready = ready.where(F.col("device") != exclude)
    pairs = F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(c).alias("priority")) for r, c in roles.items()]
    )
    long = ready.select(by, "device", F.explode(pairs).alias("p")).select(by, "device", "p.*")
    return (
        long.groupBy(by, "role")
        .agg(F.min(F.struct("priority", "device")).alias("best"))
        .select(by, "role", "best.device", "best.priority")
    )
