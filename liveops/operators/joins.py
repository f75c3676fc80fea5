"""As-of and interval joins written as one ordered pass per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.operators.ordered import latest, ordered


def asof(left: DataFrame, right: DataFrame, keys, at: str, tie: str, take: list[str],
         strict: bool = False) -> DataFrame:
    """For each left row the last right row of its key at or before it (``strict``: before).

    Both sides carry the columns ``keys``, ``at`` and ``tie``. They are united and
    scanned once, so no pairs are formed and a huge key is cut into blocks.
    """
    keys = list(keys)
    rest = [c for c in left.columns if c not in (*keys, at, tie)]
    side_left, side_right = (0, 1) if strict else (1, 0)
    both = left.select(
        *keys, at, tie, F.lit(side_left).alias("_side"),
        F.struct(F.lit(True).alias("_here"), *rest).alias("_l"),
    ).unionByName(
        right.select(
            *keys, at, tie, F.lit(side_right).alias("_side"), F.struct(*take).alias("_r")
        ),
        allowMissingColumns=True,
    )
    rows = ordered(both, keys, [at, "_side", tie]).running(_m=latest("_r"))
    return rows.df.where(F.col("_side") == side_left).select(
        *keys, at, tie, *[f"_l.{c}" for c in rest], *[f"_m.{c}" for c in take]
    )


def during(points: DataFrame, spans: DataFrame, keys, at: str, tie: str, take: list[str],
           begin: str = "from_ts", end: str = "to_ts", outer: bool = False) -> DataFrame:
    """Points inside a span of their key, where spans of one key do not overlap.

    A span covers ``begin <= at < end``; a null end is open. Only the last span
    begun can cover a point, so this is an as-of join and a comparison.
    """
    right = spans.withColumns({at: F.col(begin), tie: F.lit(0).cast("bigint")})
    wanted = list(dict.fromkeys([*take, begin, end]))
    found = asof(points, right, keys, at, tie, wanted)
    inside = F.col(begin).isNotNull() & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    if not outer:
        return found.where(inside)
    return found.withColumns({c: F.when(inside, F.col(c)) for c in wanted})


def overlapping(points: DataFrame, spans: DataFrame, key: str, at: str, cell: int,
                begin: str = "from_ts", end: str = "to_ts") -> DataFrame:
    """Every (point, span) pair of one key with ``begin <= at < end``; spans may overlap.

    Spans are laid over cells of ``cell`` time units and points fall in one, so
    the equi-join on (key, cell) forms few pairs beyond the result and spreads a
    large key over its cells. An open span reaches to the last point there is.
    """
    close = F.coalesce(F.col(end), points.agg(F.max(at)).scalar() + 1)
    laid = spans.withColumn("_close", close).where(F.col("_close") > F.col(begin)).withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col(begin) / cell), F.floor((F.col("_close") - 1) / cell))),
    )
    placed = points.withColumn("_cell", F.floor(F.col(at) / cell))
    hit = (F.col(at) >= F.col(begin)) & (F.col(at) < F.col("_close"))
    return placed.join(laid, [key, "_cell"]).where(hit).drop("_cell", "_close")
