"""Copies handed out one by one against the totals computed without pairs."""

import pytest
from pyspark.sql import functions as F

from liveops.operators import media, membership
from liveops.operators.joins import asof
from liveops.plans.fixtures import HOUR, Tables


@pytest.fixture(scope="module")
def tables(spark, folder):
    return Tables(spark, folder)


def test_delivery_pairs_match_totals(tables):
    spans, tags = membership.intervals(tables.signals()), tables.frames()
    pairs = media.deliver(tags, spans, 6 * HOUR).groupBy("channel", "client", "from_id").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes")
    )
    totals = media.delivered(tags, spans).where(F.col("copies") > 0)
    columns = ["channel", "client", "from_id", "copies", "bytes"]
    assert sorted(pairs.select(columns).collect()) == sorted(totals.select(columns).collect())
    assert pairs.count()


def test_fanout_pairs_match_counts(spark, tables):
    rows = tables.chat()
    members = rows.select("channel", F.col("speaker").alias("client")).distinct()
    sent = rows.select("channel", "us", F.col("speaker").alias("sender"))
    sizes = {r["channel"]: r["count"] for r in members.groupBy("channel").count().collect()}
    everyone = membership.fanout(sent, members, include_self=True).groupBy("channel", "us").count()
    assert all(r["count"] == sizes[r["channel"]] for r in everyone.collect())
    others = membership.fanout(sent, members).groupBy("channel", "us").count()
    assert all(r["count"] == sizes[r["channel"]] - 1 for r in others.collect())


def test_asof_takes_equal_times_unless_strict(spark):
    left = spark.createDataFrame([(1, 5, 0), (1, 4, 1)], "k bigint, us bigint, id bigint")
    right = spark.createDataFrame([(1, 5, 0, "a")], "k bigint, us bigint, id bigint, v string")
    got = {r.us: r.v for r in asof(left, right, ["k"], "us", "id", ["v"]).collect()}
    assert got == {5: "a", 4: None}
    got = {r.us: r.v for r in asof(left, right, ["k"], "us", "id", ["v"], strict=True).collect()}
    assert got == {5: None, 4: None}


def test_lookup_counts_before_it_joins(spark, folder):
    """Equal requests are one row of the joins, not each a row of a wide table to be grouped."""
    from liveops.plans.registry import QUERIES

    plan = QUERIES["p2p_lookup"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
