"""Known values of the scalar functions and small operators."""

import random

import pytest
from pyspark.sql import functions as F

from liveops.functions import arrays, levels, maps, text
from liveops.functions.binary import POLYNOMIAL, crc32_mpeg
from liveops.operators import membership, packets, rules


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(column.alias("r")).first().r


def test_crc(spark):
    got = one(spark, crc32_mpeg(F.col("d"), 0xFFFFFFFF), d=bytearray(b"123456789"))
    assert got == 0x0376E6E7


def test_crc_of_any_bytes(spark):
    """As bit by bit, from any start, in one call a value and not a step for each byte."""
    def plain(data, register):
        for byte in data:
            register ^= byte << 24
            for _ in range(8):
                register = (register << 1 ^ (POLYNOMIAL if register >> 31 else 0)) & 0xFFFFFFFF
        return register

    rng = random.Random(7)
    rows = [(b"",), (b"\0\0",), (bytes(range(256)),), (None,), *[(rng.randbytes(500),) for _ in range(20)]]
    df = spark.createDataFrame(rows, "d binary")
    for start in (0, 1, 0xFFFFFFFF, 0x12345678):
        found = df.select("d", crc32_mpeg("d", start).alias("crc"))
        assert "aggregate" not in found._jdf.queryExecution().toString().lower()
        for r in found.collect():
            assert r.crc == (None if r.d is None else plain(r.d, start))


def test_level_round_trip(spark):
    rows = spark.range(0, 200000, 37).select(
        "id", levels.from_linear(levels.to_linear(F.col("id"))).alias("back")
    )
    assert rows.where(F.abs(F.col("id") - F.col("back")) > 1).count() == 0


def test_request_line(spark):
    line = "post MLGB/?channel=123&src=192.168.1.11:54321&channel=9 http/1.1\r\n"
    got = one(spark, text.request_line("l"), l=line)
    assert got.method == "post" and got.version == "1.1"
    assert got.args == {"channel": "123", "src": "192.168.1.11:54321"}
    for bad in ("nospace", "GET /a=b HTTP/1.1", "GET /a?b=c"):
        assert one(spark, text.request_line("l"), l=bad) is None


def test_host_port(spark):
    assert one(spark, text.host_port("a"), a="h:81").port == 81
    assert one(spark, text.host_port("a"), a="h:x").port == 80


def test_signals(spark):
    got = one(spark, membership.parse_signal(F.col("s")), s="CAMERA_CREATE_c1_123")
    assert (got.type, got.action, got.channel, got.epoch, got.uid) == (
        "CAMERA", "CREATE", "c1", 123, None)
    assert one(spark, membership.parse_signal(F.col("s")), s="TV_CREATE_c1_123") is None


def test_saturating_mix(spark):
    a = F.array(*[F.lit(x) for x in (30000, -30000, 100)])
    assert one(spark, arrays.mix([a, a])) == [32767, -32768, 200]


def test_remap_keeps_equal_layout(spark):
    v = F.array(F.lit(1), F.lit(9))
    assert one(spark, arrays.remap(v, ["mono", "lfe"], ["mono", "lfe"])) == [1, 9]
    assert one(spark, arrays.remap(v, ["front-left", "front-right"], ["mono"])) == [5]


def test_property_modes(spark):
    old, new = F.create_map(F.lit("a"), F.lit("1")), F.create_map(
        F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))
    assert one(spark, maps.update(old, new, "merge")) == {"a": "1", "b": "3"}
    assert one(spark, maps.update(old, new, "replace")) == {"a": "2", "b": "3"}
    assert one(spark, maps.update(old, new, "set")) == {"a": "2", "b": "3"}
    with pytest.raises(ValueError):
        maps.update(old, new, "other")


@pytest.mark.parametrize(
    "networks, expected",
    [
        (["127.0.0.1"], True), (["127.0.0.2/0"], True), (["127.0.0.1/32"], True),
        (["127.0.0.1/7"], True), (["127.0.0.2"], False), (["127.0.0.0/8", "0.0.0.0/32"], True),
        (["128.0.0.2/9"], False), (["::1/9"], False),
    ],
)
def test_networks_ipv4(spark, networks, expected):
    df = spark.createDataFrame([(0x7F000001,)], "ip bigint")
    found = rules.in_networks(df, networks, rules.ipv4_hex(F.col("ip")))
    assert bool(found.count()) is expected


def test_networks_ipv6(spark):
    df = spark.createDataFrame([("0" * 31 + "1",), ("FE80" + "0" * 28,)], "ip string")
    assert rules.in_networks(df, ["::1/128", "::/127"], F.col("ip")).count() == 1
    assert rules.in_networks(df, ["fe80::/10"], F.col("ip")).count() == 1


def test_rule_lines():
    got = rules.load(["# c", "^a 10", 'b "media.role=event"', ""])
    assert [(r.pattern, r.level, r.props) for r in got] == [
        ("^a", 10, {}), ("b", None, {"media.role": "event"})]


def test_unwrap_half_goes_up(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 0), (0, 1, 1, 32768), (0, 2, 2, 65535), (0, 3, 3, 2)],
        "stream bigint, us bigint, event_id bigint, seq int",
    )
    rows = packets.unwrap(packets.arrivals(df), "seq", 16, "useq").result()
    assert [r.useq for r in rows.orderBy("us").collect()] == [0, 32768, 65535, 65538]


def test_lost_and_received_make_the_span(spark, folder):
    from liveops.plans.fixtures import Tables

    rows = Tables(spark, folder).packets()
    lost = packets.gaps(rows).groupBy("stream").agg(F.sum("missing").alias("lost"))
    have = rows.groupBy("stream").agg(
        F.count_distinct("seq").alias("have"), (F.max("seq") - F.min("seq") + 1).alias("span")
    )
    off = have.join(lost, "stream", "left").where(
        F.col("have") + F.coalesce("lost", F.lit(0)) != F.col("span")
    )
    assert off.count() == 0
