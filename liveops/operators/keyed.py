"""Latest and first row per key, and idle spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveops.operators.ordered import ordered, previous, total


def _pick(df: DataFrame, key, order, choose) -> DataFrame:
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in key]
    # A grouped aggregate combines on the map side, so a huge key ships one row per task.
    row = choose(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(row).select(*key, *[f"_row.{c}" for c in rest])


def latest(df: DataFrame, key, order) -> DataFrame:
    """Row with the greatest order per key: a hash where each write replaces the last."""
    return _pick(df, key, order, F.max_by)


def first(df: DataFrame, key, order) -> DataFrame:
    """Row with the least order per key: insert only if absent."""
    return _pick(df, key, order, F.min_by)


def idle(df: DataFrame, key: str, ts: str, gap_us: Column, tie: str) -> DataFrame:
    """Active spans per key: a span ends once no row came for ``gap_us`` (negative: never)."""
    at = F.unix_micros(ts)
    rows = ordered(df.withColumns({"_at": at, "_gap": gap_us}), [key], ["_at", tie])
    rows = rows.running(_prev=previous("_at"))
    opens = (F.col("_gap") >= 0) & (F.col("_at") - F.col("_prev") >= F.col("_gap"))
    rows = rows.running(
        span=total(F.when(F.col("_prev").isNull() | opens, 1).otherwise(0).cast("bigint"))
    )
    return (
        rows.df.groupBy(key, "span")
        .agg(
            F.min("_at").alias("from_us"),
            F.max("_at").alias("last_us"),
            F.max("_gap").alias("_gap"),
            F.count(F.lit(1)).alias("rows"),
        )
        .withColumn("suspend_us", F.when(F.col("_gap") >= 0, F.col("last_us") + F.col("_gap")))
        .drop("_gap")
    )
