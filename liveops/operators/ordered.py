"""Ordered computations per key that stay parallel when one key is huge.

A window runs each key in one task, which spills but is not shared. With
``spark.liveops.hotRows`` set, keys of more rows are range-partitioned on (key, order)
into consecutive blocks, windows run per block, and one summary row per block carries
the state forward. Unset, nothing is counted and the plan is a plain window: no job
runs while it is built.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liveops.session import shared_folder, written

HOT_ROWS = "spark.liveops.hotRows"
BROADCAST_ROWS = 100_000
BLOCK = "_block"


@dataclass(frozen=True)
class Running:
    """One ordered aggregate: ``kind`` over the rows up to (or before, after) each row."""

    kind: str
    value: Column
    inclusive: bool = True


def total(value, inclusive=True) -> Running:
    return Running("sum", _col(value), inclusive)


def highest(value, inclusive=True) -> Running:
    return Running("max", _col(value), inclusive)


def lowest(value, inclusive=True) -> Running:
    return Running("min", _col(value), inclusive)


def latest(value, inclusive=True) -> Running:
    """Last non-null value so far."""
    return Running("last", _col(value), inclusive)


def coming(value) -> Running:
    """First non-null value after the row."""
    return Running("coming", _col(value), False)


def previous(value) -> Running:
    return Running("lag", _col(value), False)


def following(value) -> Running:
    return Running("lead", _col(value), False)


def position() -> Running:
    """1-based row number."""
    return Running("sum", F.lit(1).cast("bigint"))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _local(spec: Running, window) -> Column:
    so_far = window.rowsBetween(
        Window.unboundedPreceding, Window.currentRow if spec.inclusive else -1
    )
    ahead = window.rowsBetween(1, Window.unboundedFollowing)
    return {
        "sum": lambda: F.sum(spec.value).over(so_far),
        "max": lambda: F.max(spec.value).over(so_far),
        "min": lambda: F.min(spec.value).over(so_far),
        "last": lambda: F.last(spec.value, ignorenulls=True).over(so_far),
        "coming": lambda: F.first(spec.value, ignorenulls=True).over(ahead),
        "lag": lambda: F.lag(spec.value).over(window),
        "lead": lambda: F.lead(spec.value).over(window),
    }[spec.kind]()


def _summary(spec: Running, at: Column) -> Column:
    """The block's contribution to its neighbours."""
    known = F.when(spec.value.isNotNull(), at)
    return {
        "sum": lambda: F.sum(spec.value),
        "max": lambda: F.max(spec.value),
        "min": lambda: F.min(spec.value),
        "last": lambda: F.max_by(spec.value, known),
        "coming": lambda: F.min_by(spec.value, known),
        "lag": lambda: F.max_by(spec.value, at),
        "lead": lambda: F.min_by(spec.value, at),
    }[spec.kind]()


def _carry(kind: str, name: str, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    after = window.rowsBetween(1, Window.unboundedFollowing)
    return {
        "sum": lambda: F.sum(name).over(before),
        "max": lambda: F.max(name).over(before),
        "min": lambda: F.min(name).over(before),
        "last": lambda: F.last(name, ignorenulls=True).over(before),
        "coming": lambda: F.first(name, ignorenulls=True).over(after),
        "lag": lambda: F.lag(name).over(window),
        "lead": lambda: F.lead(name).over(window),
    }[kind]()


def _merge(kind: str, here: Column, carried: Column, first: Column, last: Column) -> Column:
    return {
        "sum": lambda: F.when(here.isNull(), carried)
        .when(carried.isNull(), here)
        .otherwise(here + carried),
        "max": lambda: F.greatest(here, carried),
        "min": lambda: F.least(here, carried),
        "last": lambda: F.coalesce(here, carried),
        "coming": lambda: F.coalesce(here, carried),
        "lag": lambda: F.when(first, carried).otherwise(here),
        "lead": lambda: F.when(last, carried).otherwise(here),
    }[kind]()


@dataclass(frozen=True)
class Ordered:
    """Rows grouped by ``keys`` in ascending ``order``, perhaps cut into ``blocks``."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    blocks: int = 0

    @property
    def parts(self) -> list[str]:
        return [*self.keys, BLOCK] if self.blocks else list(self.keys)

    def map(self, columns: dict[str, Column]) -> Ordered:
        return replace(self, df=self.df.withColumns(columns))

    def running(self, **specs: Running) -> Ordered:
        """Add one column per ordered aggregate."""
        window = Window.partitionBy(*self.parts).orderBy(*self.order)
        local = {name: _local(spec, window) for name, spec in specs.items()}
        if not self.blocks:
            return self.map(local)
        if any(s.kind == "lag" for s in specs.values()):
            local["_first"] = F.lag(F.lit(1)).over(window).isNull()
        if any(s.kind == "lead" for s in specs.values()):
            local["_last"] = F.lead(F.lit(1)).over(window).isNull()
        at = F.struct(*self.order)
        across = Window.partitionBy(*self.keys).orderBy(BLOCK)
        # One small row per block. Written out, a chain of such passes stays a chain;
        # as plans, each pass would hold the one before it twice.
        carried = written(
            self.df.where(F.col(BLOCK) >= 0)
            .groupBy(*self.parts)
            .agg(*[_summary(spec, at).alias(name) for name, spec in specs.items()])
            .select(
                *[F.col(p).alias(f"_k{i}") for i, p in enumerate(self.parts)],
                *[_carry(s.kind, n, across).alias(f"_c_{n}") for n, s in specs.items()],
            )
        )
        if self.blocks <= BROADCAST_ROWS:
            carried = F.broadcast(carried)
        match = [F.col(p).eqNullSafe(F.col(f"_k{i}")) for i, p in enumerate(self.parts)]
        joined = self.df.withColumns(local).join(carried, match, "left")
        merged = {
            name: _merge(
                spec.kind, F.col(name), F.col(f"_c_{name}"), F.col("_first"), F.col("_last")
            )
            for name, spec in specs.items()
        }
        keep = [c for c in self.df.columns if c not in merged]
        return replace(
            self, df=joined.select(*keep, *[c.alias(n) for n, c in merged.items()])
        )

    def tail(self, width: int, **frames) -> Ordered:
        """Columns over the last ``width`` rows; each frame maps a window to a column.

        With blocks, rows go to chunks of a fixed row count that also hold the
        few rows before them, so a frame never has to reach another task.
        """

        def last(window):
            return window.rowsBetween(1 - width, Window.currentRow)

        if not self.blocks:
            window = last(Window.partitionBy(*self.keys).orderBy(*self.order))
            return self.map({name: frame(window) for name, frame in frames.items()})
        size = max(8 * CHUNK, 2 * width)
        place = F.col("_place") - 1
        rows = self.running(_place=position()).df.withColumn("_chunk", F.floor(place / size))
        rows = rows.withColumn("_halo", F.lit(False))
        halo = rows.where(place % size > size - width).withColumns(
            {"_chunk": F.col("_chunk") + 1, "_halo": F.lit(True)}
        )
        window = last(Window.partitionBy(*self.keys, "_chunk").orderBy("_place"))
        framed = rows.unionByName(halo).withColumns(
            {name: frame(window) for name, frame in frames.items()}
        )
        return replace(
            self, df=framed.where(~F.col("_halo")).drop("_place", "_chunk", "_halo")
        )

    def result(self, *drop: str) -> DataFrame:
        return self.df.drop(BLOCK, *drop)


def ordered(df: DataFrame, keys, order) -> Ordered:
    """Order ``df`` per key, cutting keys above the row threshold into blocks.

    ``order`` must end in a column that makes rows distinct. A row threshold is
    for data known to have keys too large for a task: finding them costs a pass over
    the key columns with map-side counting, and a shared checkpoint folder is needed
    for the blocks.
    """
    keys, order = tuple(keys), tuple(order)
    spark = df.sparkSession
    limit = int(spark.conf.get(HOT_ROWS, "0"))
    if limit <= 0:
        return Ordered(df, keys, order)
    shared_folder(spark)  # better missing now than once a key has grown
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    found = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows")).first()
    if not found.n:
        return Ordered(df, keys, order)
    hot = sizes.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)])
    if found.n <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    match = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)]
    blocks = max(2, math.ceil(found.rows / limit))
    # Block numbers depend on sampled range bounds, so they are written once and
    # every later stage, retries included, reads the same numbers.
    large = written(
        df.join(hot, match, "left_semi")
        .repartitionByRange(blocks, *keys, *order)
        .withColumn(BLOCK, F.spark_partition_id().cast("bigint"))
    )
    small = df.join(hot, match, "left_anti").withColumn(BLOCK, F.lit(-1).cast("bigint"))
    return Ordered(small.unionByName(large), keys, order, blocks)


CHUNK = 512
#: Natural logarithm of weights that double precision still holds with room to spare.
REACH = 575.0


def smooth(rows: Ordered, value: str, gain: float, out: str, start: float = 0.0) -> Ordered:
    """Exponential mean ``m += gain * (value - m)`` per key from ``start``, for any gain in (0, 1].

    Rows are summed with growing weights in chunks, and so are the ends of chunks in
    groups. Weights reach e^575 at most, and what lies two groups back weighs less than
    e^-575: the result is exact to double precision whatever the gain.
    """
    if not 0 < gain <= 1:
        raise ValueError("gain must be above 0 and at most 1")
    keep = 1.0 - gain
    if not keep:
        return rows.map({out: F.col(value).cast("double")})
    size = max(1, min(CHUNK, int(REACH / -math.log(keep))))
    fade = keep**size
    group = max(1, min(1 << 40, int(REACH / -math.log(fade)))) if fade > 0 else 1
    rows = rows.running(_pos=position()).map(
        {
            "_chunk": F.floor((F.col("_pos") - 1) / size),
            "_i": (F.col("_pos") - 1) % size,
        }
    ).map({"_group": F.floor(F.col("_chunk") / group), "_g": F.col("_chunk") % group})
    inside = Window.partitionBy(*rows.keys, "_chunk").orderBy("_i")
    weight = F.pow(F.lit(keep), -(F.col("_i") + 1))
    rows = rows.map({"_s": F.sum(F.col(value) * gain * weight).over(inside)})
    at_end = F.col("_i") == size - 1
    before = (
        Window.partitionBy(*rows.keys, "_group").orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = F.sum(F.when(at_end, F.col("_s") * F.pow(F.lit(fade), -F.col("_g")))).over(before)
    rows = rows.map({"_own": F.pow(F.lit(fade), F.col("_g")) * F.coalesce(ends, F.lit(0.0))})
    rows = rows.running(_past=latest(
        F.when(at_end & (F.col("_g") == group - 1), (F.col("_s") + F.col("_own")) * fade),
        inclusive=False,
    ))
    begin = (
        F.col("_own") + F.pow(F.lit(fade), F.col("_g")) * F.coalesce("_past", F.lit(0.0))
        + start * F.pow(F.lit(fade), F.col("_chunk"))
    )
    rows = rows.map({out: F.pow(F.lit(keep), F.col("_i") + 1) * (F.col("_s") + begin)})
    return replace(
        rows, df=rows.df.drop("_pos", "_chunk", "_i", "_group", "_g", "_s", "_own", "_past")
    )
