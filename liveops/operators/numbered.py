"""Global row numbers without a single task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least number of parts; sessions with more shuffle partitions get two for each of those.
PARTS = 1024
#: Sampled rows behind each splitter: the bound of the sample is ``PER_PART`` times the parts.
PER_PART = 20


def part_count(df: DataFrame) -> int:
    """Parts for ``df``: at least ``PARTS``, and twice the session's shuffle partitions."""
    return max(PARTS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def splitters(df: DataFrame, order, parts: int) -> Column:
    """Rising tuples of ``order`` that cut ``df`` into about ``parts`` parts of like size.

    A scalar subquery, so building it starts no job. Rows fall into buckets by a hash of all
    order columns, and the tuple of least hash of each bucket is the sample: it depends on the
    rows alone, combines on the map side and holds ``PER_PART * parts`` tuples at most. Equal
    values of the first columns are cut by the next ones, as tuples are compared whole.
    """
    order = list(order)
    keys = df.select(*order, F.xxhash64(*order).alias("_hash"))
    bucket = F.pmod("_hash", F.lit(PER_PART * parts))
    least = keys.groupBy(bucket.alias("_bucket")).agg(F.min("_hash").alias("_hash")).select("_hash")
    # At most PER_PART * parts hashes. Rows of one hash are copies of one tuple.
    sample = keys.join(F.broadcast(least), "_hash", "left_semi").distinct()
    tuples = F.sort_array(F.collect_list(F.struct(*order)))
    n = F.size("_all")
    step = F.floor(n / F.lit(parts)) + 1
    cuts = F.transform(
        F.filter(F.sequence(step, n + step, step), lambda i: i < n),
        lambda i: F.element_at("_all", (i + 1).cast("int")),
    )
    return sample.agg(tuples.alias("_all")).select(cuts.alias("_cuts")).scalar()


def place(order, parts: int, cuts: str = "_cuts") -> Column:
    """How many of the rising tuples of the column ``cuts`` are at most a row, by bisection."""
    steps = [1 << b for b in range((parts + 1).bit_length(), -1, -1)]
    key = F.struct(*order)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= key, step).otherwise(0),
    )


def parted(df: DataFrame, order, parts: int, out: str = "_part") -> DataFrame:
    """``df`` with the number of its part: how many of the ``splitters`` are at most its row."""
    # A column of its own: a subquery cannot stand inside a lambda.
    cut = df.withColumn("_cuts", splitters(df, order, parts))
    return cut.withColumn(out, place(order, parts)).drop("_cuts")


def numbered(df: DataFrame, order, out: str = "n") -> DataFrame:
    """0-based place of each row in ascending ``order``, which must make rows distinct.

    Rows are cut into parts of like size by ``splitters`` over all order columns, whatever
    their distribution; the parts depend on the data alone, so a retried task sees the same
    ones. A row's place is its place in the part plus the sizes of the parts before. Nulls
    come first; rows that are equal in all order columns stay in one part.
    """
    order = [order] if isinstance(order, str) else list(order)
    parts = part_count(df)
    placed = parted(df, order, parts)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per part: the only window without a key runs over these few rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.withColumn("_seat", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_seat") + F.col("_offset"))
        .drop("_part", "_seat", "_offset")
    )
