"""Global numbers whose parts are of like size whatever the first column holds."""

import pytest
from pyspark.sql import functions as F

from liveops.operators import numbered as module
from liveops.operators.numbered import numbered, parted


def _largest(df, order, parts):
    return max(r["count"] for r in parted(df, order, parts, "p").groupBy("p").count().collect())


@pytest.mark.parametrize("first", [
    "7",  # one repeated value
    "CASE WHEN id = 5 THEN 1000000000000000 ELSE id END",  # an outlier
    "concat('http://a.example/common/prefix/', id)",
    "CASE WHEN id % 3 > 0 THEN id END",  # a third are null
])
def test_parts_are_of_like_size(spark, first):
    rows = spark.range(20_000).selectExpr(f"{first} AS a", "id AS b")
    parts = 50
    assert _largest(rows, ["a", "b"], parts) < 4 * 20_000 / parts


@pytest.mark.parametrize("first", ["id % 7", "CASE WHEN id = 3 THEN 1000000000000 ELSE -id END",
                                   "concat('common prefix ', id % 100)"])
def test_places(spark, first):
    rows = spark.range(3_000).selectExpr(f"{first} AS a", "id AS b")
    got = {(r.a, r.b): r.n for r in numbered(rows, ["a", "b"]).collect()}
    assert [n for _, n in sorted(got.items())] == list(range(3_000))


def test_small_and_empty(spark):
    rows = spark.createDataFrame([(None, 1), (2, 1), (2, 1)], "a int, b int")
    assert [(r.a, r.n) for r in numbered(rows, ["a", "b"]).orderBy("n").collect()] == [
        (None, 0), (2, 1), (2, 2)
    ]
    assert numbered(rows.limit(0), "a").collect() == []


def test_no_job(spark):
    rows = spark.range(100).withColumn("b", F.col("id") % 3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("numbered", "")
    try:
        numbered(rows, ["b", "id"])
        assert not tracker.getJobIdsForGroup("numbered")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert module.part_count(rows) >= module.PARTS
