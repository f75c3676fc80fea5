"""Value series: order statistics, best runs, drift, smoothed time, spectra."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liveops.operators.fold import fold
from liveops.operators.ordered import Ordered, highest, lowest, ordered, previous, total

# Samples of clock history kept, and band edges of the spectral score.
HISTORY_MAX = 64
BANDS = (0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 68, 80, 96, 120, 156, 200)


def sort(df: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.col(by).asc() if ascending else F.col(by).desc())


def top_k(df: DataFrame, by: str, k: int, tie) -> DataFrame:
    """The ``k`` rows with the largest values; ``tie`` columns decide equals."""
    return df.orderBy(F.col(by).desc(), *tie).limit(k)


def kth_largest(df: DataFrame, k: int, key: str, value: str, tie) -> DataFrame:
    """The k-th largest value per key; Spark keeps k rows per key and task before the shuffle."""
    window = Window.partitionBy(key).orderBy(F.col(value).desc(), *tie)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") <= k)
        .where(F.col("_rank") == k)
        .select(key, value)
    )


def extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("greatest"))


def contains(df: DataFrame, values: DataFrame, on) -> DataFrame:
    """Rows whose value is among ``values``; repeated rows stay."""
    return df.join(values, on, "left_semi")


def run_sums(df: DataFrame, key: str, order, value: str) -> DataFrame:
    """Greatest (at least 0) and least sum of consecutive rows per key.

    A run is a difference of two prefix sums, so the best one ending at a row
    needs the least, or greatest, prefix before it.
    """
    rows = ordered(df, [key], order).running(_sum=total(value))
    rows = rows.running(
        _low=lowest("_sum", inclusive=False), _high=highest("_sum", inclusive=False)
    )
    zero = F.lit(0).cast("bigint")
    up = F.col("_sum") - F.least(zero, F.col("_low"))
    down = F.col("_sum") - F.greatest(zero, F.col("_high"))
    return rows.df.groupBy(key).agg(
        F.greatest(zero, F.max(up)).alias("max_run"), F.min(down).alias("min_run")
    )


# clocks -------------------------------------------------------------------------------
def _dot(samples: Column, a, b) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda acc, s: acc + a(s) * b(s))


def _mean(field: str) -> Column:
    return F.expr(f"aggregate(_kept, 0L, (acc, s) -> acc + s.{field}) div size(_kept)")


def drift_rows(df: DataFrame, key: str, history: int, min_history: int,
               monotonic: bool) -> Ordered:
    """Least-squares slope over the samples still kept; 1 when there are too few."""
    rows = ordered(df, [key], ["x"]).tail(
        HISTORY_MAX, _h=lambda w: F.collect_list(F.struct("x", "y")).over(w)
    )
    oldest = F.size("_h") - 1 - min_history
    kept = F.filter(
        "_h", lambda s, i: (s["x"] + history >= F.col("x")) | (i >= oldest)
    )
    # Step by step, so that each array is worked out once per row.
    rows = rows.map({"_kept": kept}).map({"_ax": _mean("x"), "_ay": _mean("y")})

    def dx(s):
        return (s["x"] - F.col("_ax")).cast("double")

    def dy(s):
        return (s["y"] - F.col("_ay")).cast("double")

    slope = _dot(F.col("_kept"), dx, dy) / _dot(F.col("_kept"), dx, dx)
    if monotonic:
        slope = F.greatest(slope, F.lit(0.0))
    rows = rows.map({"slope": F.when(F.size("_kept") < min_history, 1.0).otherwise(slope)})
    return replace(rows, df=rows.df.drop("_h", "_kept", "_ax", "_ay"))


def drift(df: DataFrame, key: str, history: int, min_history: int,
          monotonic: bool = False) -> DataFrame:
    """Slope of ``y`` over ``x`` at each sample of a key from its recent history.

    At most 64 samples count; older ones than ``history`` go unless fewer than
    ``min_history`` would stay. ``x`` is distinct within a key.
    """
    return drift_rows(df, key, history, min_history, monotonic).result()


def between(start: tuple, goal: tuple, x: int) -> tuple[int, float]:
    """Value and slope at ``x`` of the cubic through two points (x, y, slope) with their slopes.

    In Hermite form over the unit interval. From the goal on it is the goal's line.
    """
    (x0, y0, slope0), (x1, y1, slope1) = start, goal
    if x >= x1:
        return max(0, y1 + round(slope1 * (x - x1))), slope1
    width = x1 - x0
    u = (x - x0) / width
    rise = (y1 - y0) * u * u * (3 - 2 * u) + width * u * (1 - u) * ((1 - u) * slope0 - u * slope1)
    slope = (y1 - y0) / width * 6 * u * (1 - u)
    slope += slope0 * (1 - u) * (1 - 3 * u) + slope1 * u * (3 * u - 2)
    return max(0, y0 + round(rise)), slope


def clock_begin() -> dict:
    return {"now": (0, 0, 1.0), "goal": None}


def clock_step(state: dict, row: dict) -> list[dict]:
    """Estimate at one sample, then aim to be on the measured line after ``adjust``."""

    def ahead(x, y, slope):
        return x + row["adjust"], y + round(slope * row["adjust"]), slope

    if state["goal"] is None:
        # The goal of the sample before is reached, so nothing older matters.
        known = row["_x"] is not None
        state["goal"] = ahead(row["_x"], row["_y"], row["_slope"]) if known else (0, 0, 1.0)
    value, slope = between(state["now"], state["goal"], row["x"])
    if row["monotonic"]:
        slope = max(0.0, slope)
    state["now"] = row["x"], value, slope
    state["goal"] = ahead(row["x"], row["y"], row["slope"])
    return [{"x": row["x"], "y": row["y"], "smooth": value}]


def smooth_time(df: DataFrame, key: str, history: int, min_history: int, adjust: int,
                monotonic: bool = False, smoothing: bool = True) -> DataFrame:
    """Smoothed ``y`` at each sample of a key; if ``monotonic`` it never falls.

    Once a sample comes ``adjust`` or more after the one before, the estimate is
    on that one's line and owes nothing to the past, so series are cut there.
    Without ``smoothing`` every estimate is on the line of the sample before.
    """
    rows = drift_rows(df, key, history, min_history, monotonic)
    rows = rows.running(_x=previous("x"), _y=previous("y"), _slope=previous("slope"))
    if smoothing:
        fresh = F.col("_x").isNull() | (F.col("x") - F.col("_x") >= adjust)
        rows = rows.map({"_fresh": fresh.cast("bigint")}).running(piece=total("_fresh"))
        settings = {"adjust": F.lit(adjust).cast("bigint"), "monotonic": F.lit(monotonic)}
        out = fold(
            rows.map(settings).df.select(
                key, "piece", "x", "y", "slope", "_x", "_y", "_slope", "adjust", "monotonic"
            ),
            [key, "piece"], ["x"], clock_begin, clock_step,
            f"{key} bigint, x bigint, y bigint, smooth bigint",
        )
    else:
        line = F.col("_y") + F.rint(F.col("_slope") * (F.col("x") - F.col("_x"))).cast("bigint")
        value = F.greatest(F.lit(0).cast("bigint"), F.coalesce(line, F.col("x")))
        out = rows.map({"smooth": value}).result().select(key, "x", "y", "smooth")
    if monotonic:
        out = ordered(out, [key], ["x"]).running(smooth=highest("smooth")).result()
    return out


# spectra --------------------------------------------------------------------------------
def spectral_score(a: DataFrame, b: DataFrame, bands=BANDS) -> DataFrame:
    """Score of ``b`` against ``a``, both rows (frame, bin, power), 100 being equal.

    Per cell ``r - ln r - 1``, its mean per band, squared and pooled over the
    fixed number of bands and all frames; cells 79 to 81 count less.
    """
    cell = F.col("_b") / F.col("_a")
    weight = F.when(F.col("bin") == 80, 0.01).when(F.col("bin").between(79, 81), 0.1).otherwise(1.0)
    band, width = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(bands, bands[1:])):
        inside = (F.col("bin") >= low) & (F.col("bin") < high)
        band = F.when(inside, i).otherwise(band)
        width = F.when(inside, high - low).otherwise(width)
    pairs = a.withColumnRenamed("power", "_a").join(
        b.withColumnRenamed("power", "_b"), ["frame", "bin"]
    )
    cells = pairs.withColumns(
        {"band": band, "width": width, "_e": (cell - F.ln(cell) - 1) * weight}
    ).where(F.col("band").isNotNull())
    per_band = cells.groupBy("frame", "band").agg((F.sum("_e") / F.max("width")).alias("_e"))
    per_frame = per_band.groupBy("frame").agg(
        (F.sum(F.col("_e") * F.col("_e")) / (len(bands) - 1)).alias("_e")
    )
    return per_frame.agg(F.avg(F.pow("_e", 4)).alias("_e")).select(
        F.pow("_e", F.lit(1 / 16)).alias("error"),
        (100 * (1 - 0.5 * F.ln(1 + F.pow("_e", F.lit(1 / 16))) / F.ln(F.lit(1.13)))).alias("score"),
    )
