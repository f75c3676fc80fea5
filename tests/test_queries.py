"""Every registered query against its SQL twin, and with every larger key cut into blocks."""

import pytest
from compare import check, connect

import __spark_entry__ as entry
from liveops.operators.ordered import HOT_ROWS
from liveops.plans import QUERIES as PLANNED
from liveops.plans.fixtures import Tables
from liveops.plans.stored_queries import STORED

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Queries whose operators scan per key; a low threshold cuts most of their keys.
SCANNING = [
    "membership_intervals", "channel_concurrency", "channel_admit", "channel_edges",
    "packet_unwrap", "packet_order", "packet_late", "packet_gaps", "packet_jitter", "packet_rtt",
    "packet_authorised", "packet_merge", "keyed_idle", "media_delivered", "media_headers_at_join",
    "media_interleave", "media_keyframe_cut", "series_run_sums", "series_drift", "fleet_rates",
    "message_fanout", "request_route", "p2p_directory", "log_rate_limit", "playlist_rolling",
    "playlist_segments_anchored",
]


@pytest.fixture(scope="session")
def con(folder):
    return connect(folder)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    assert check(spark, con, folder, QUERIES[name], ORACLES.get(name)) is None


@pytest.mark.parametrize("name", SCANNING)
def test_hot_keys(spark, con, folder, name):
    spark.conf.set(HOT_ROWS, "60")
    try:
        assert check(spark, con, folder, QUERIES[name], ORACLES[name]) is None
    finally:
        spark.conf.unset(HOT_ROWS)


def test_plans_start_no_jobs(spark, folder, monkeypatch):
    """Building a query reads nothing but the schemas of its tables."""
    read, schemas = Tables.table, {}

    def table(self, name):
        if name not in schemas:
            spark.sparkContext.setJobGroup("schemas", "")
            schemas[name] = read(self, name).schema
            spark.sparkContext.setJobGroup("plans", "")
        return spark.read.schema(schemas[name]).parquet(f"{folder}/{name}.parquet")

    monkeypatch.setattr(Tables, "table", table)
    spark.sparkContext.setJobGroup("plans", "")
    try:
        for name in sorted(set(PLANNED) - set(STORED)):
            QUERIES[name](spark, folder)
            assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans"), name
    finally:
        spark.sparkContext.setJobGroup("rest", "")


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
