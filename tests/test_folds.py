"""State machines: cut and spread by Spark against one plain pass over each key."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from liveops.operators import channels, limits, membership, packets, playlist, queues, replay, series
from liveops.operators.ordered import HOT_ROWS, ordered, smooth
from liveops.streaming import streams


SHARED = ("test_backlog", "test_admit_live", "test_playout", "test_connections", "test_membership_machine")


@pytest.fixture(params=["whole", "blocks", "parts"], autouse=True)
def hot(request, spark, monkeypatch):
    """Keys as a whole, keys over a row threshold in blocks, and rows in few parts of like size."""
    if request.param == "blocks":
        spark.conf.set(HOT_ROWS, "20")
    if request.param == "parts":
        if request.function.__name__ not in SHARED:
            pytest.skip("runs no shared replay")
        monkeypatch.setattr(replay, "part_count", lambda df: 9)
    yield
    spark.conf.unset(HOT_ROWS)


def plain(rows, key, begin, step, order=("us", "event_id"), finish=None):
    groups = defaultdict(list)
    for row in rows:
        groups[row[key]].append(row)
    out = []
    for value, members in groups.items():
        state = begin()
        for row in sorted(members, key=lambda r: [r[c] for c in order]):
            out += [{key: value} | made for made in step(state, row)]
        if finish:
            out += [{key: value} | made for made in finish(state)]
    return out


def same(df, expected, columns):
    got = sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
    assert got == sorted(tuple(r[c] for c in columns) for r in expected)
    assert got


def made(n, seed, **fields):
    rng = random.Random(seed)
    us, out = 0, []
    for i in range(n):
        us += rng.choice([1, 1, 2, 3, 20, 90]) * 1000
        out.append({"us": us, "event_id": i} | {k: f(rng) for k, f in fields.items()})
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_rate_limit(spark):
    rows = made(400, 1, source=lambda r: r.choice([0, 0, 0, 1]))
    df = frame(spark, rows, "source bigint, us bigint, event_id bigint")
    expected = plain(
        [r | {"interval": 9000, "burst": 2} for r in rows], "source", limits.limit_begin,
        limits.limit_step,
    )
    same(limits.rate_limit(df, 9000, 2), expected, ["source", "event_id", "window_us", "passed"])


def test_anchored_segments(spark):
    rows = made(400, 2, channel=lambda r: r.choice([0, 0, 1]))
    df = frame(spark, rows, "channel bigint, us bigint, event_id bigint")
    expected = plain(
        [r | {"length": 1_000_000} for r in rows], "channel", playlist.segment_begin,
        playlist.segment_step,
    )
    same(playlist.anchored_segments(df, 1), expected, ["channel", "event_id", "cut", "since_us"])


def test_backlog(spark):
    rows = made(
        500, 3, viewer=lambda r: r.choice([0, 0, 1]), is_key=lambda r: r.random() < 0.4,
        served=lambda r: r.choice([None, None, None, 0, 1, 4]),
    )
    df = frame(
        spark, rows,
        "viewer bigint, us bigint, event_id bigint, is_key boolean, served int",
    )
    expected = plain(
        [r | {"capacity": 4} for r in rows], "viewer", queues.queue_begin, queues.queue_step
    )
    same(queues.backlog(df, 4), expected, ["viewer", "event_id", "dropped_by"])


def test_drop_takes_oldest_plain_frame_then_head():
    state = queues.queue_begin()
    base = {"served": None, "capacity": 2}
    for i, key in enumerate([True, False]):
        assert queues.queue_step(state, base | {"event_id": i, "is_key": key}) == []
    drops = [
        queues.queue_step(state, base | {"event_id": i, "is_key": True})[0]["event_id"]
        for i in (2, 3)
    ]
    assert drops == [1, 0]


def test_admit_live(spark):
    rows = made(
        500, 4, channel=lambda r: r.choice([0, 0, 1]), client=lambda r: r.randrange(9),
        action=lambda r: r.choice(["JOIN", "LEAVE"]),
    )
    df = frame(
        spark, rows, "channel bigint, client bigint, action string, us bigint, event_id bigint"
    )
    expected = plain(
        [r | {"allowed": 3} for r in rows], "channel", channels.full_begin, channels.admit_step
    )
    same(channels.admit_live(df, 2), expected, ["channel", "client", "event_id", "http"])


def test_playout(spark):
    seqs = iter(range(65400, 70000))
    rows = made(
        500, 5, stream=lambda r: 0,
        seq=lambda r: (next(seqs) + r.choice([0, 0, 0, -3, 2])) % 65536,
    )
    df = frame(spark, rows, "stream bigint, us bigint, event_id bigint, seq int")
    depth, unit = 15_000, 4_000
    settings = {"depth_us": depth, "payload_us": unit, "max_us": 2 * depth}
    expected = plain(
        [r | settings for r in rows], "stream", streams.playout_begin, streams.playout_step,
        finish=lambda s: packets.playout_finish(s | {"depth": depth}),
    )
    same(packets.playout(df, depth, unit), expected, ["stream", "event_id", "status", "out_us"])


def test_connections(spark):
    rows = made(
        500, 6, stream=lambda r: r.choice([0, 0, 1]), seq=lambda r: r.randrange(3),
        kind=lambda r: r.choice(["SYN", "DATA", "DATA", "ACK", "FIN", "CONNECT", "CLOSE"]),
    )
    df = frame(spark, rows, "stream bigint, us bigint, event_id bigint, kind string, seq int")
    expected = plain(rows, "stream", packets.connection_begin, packets.connection_step)
    same(packets.connections(df), expected, ["stream", "event_id", "state", "delivered"])


def test_membership_machine(spark):
    rows = made(
        600, 7, server=lambda r: 0, channel=lambda r: r.randrange(3),
        client=lambda r: r.randrange(5),
        action=lambda r: r.choice(["CREATE", "JOIN", "JOIN", "JOIN", "LEAVE", "LEAVE", "CANCEL"]),
    )
    df = frame(
        spark, rows,
        "server bigint, channel bigint, client bigint, action string, us bigint, event_id bigint",
    )
    expected = plain(
        rows, "server", streams.room_begin, streams.room_step, finish=streams.room_finish
    )
    columns = ["channel", "client", "from_us", "from_id"]
    same(membership.machine(df), expected, columns)
    ends = {(r["from_id"]): r["to_us"] for r in expected}
    assert {r["from_id"]: r["to_us"] for r in membership.machine(df).collect()} == ends


def test_smooth_time(spark):
    rng, x, rows = random.Random(8), 0, []
    for _ in range(300):
        x += rng.choice([100, 400, 900, 5000])
        rows.append({"stream": 0, "x": x, "y": int(x * 1.2 + rng.randrange(300))})
    df = frame(spark, rows, "stream bigint, x bigint, y bigint")
    slopes = {r["x"]: r["slope"] for r in series.drift(df, "stream", 3000, 4).collect()}
    extra = {"adjust": 1000, "monotonic": False, "_x": None, "_y": None, "_slope": None}
    expected = plain(
        [r | extra | {"slope": slopes[r["x"]]} for r in rows], "stream", series.clock_begin,
        series.clock_step, order=("x",),
    )
    same(series.smooth_time(df, "stream", 3000, 4, 1000), expected, ["stream", "x", "smooth"])


def test_monotonic_time_never_falls(spark):
    rng, x, rows = random.Random(9), 0, []
    for i in range(200):
        x += rng.choice([100, 400, 900])
        rows.append({"stream": 0, "x": x, "y": x - (4000 if i % 40 > 20 else 0)})
    df = frame(spark, rows, "stream bigint, x bigint, y bigint")

    def read(**mode):
        got = series.smooth_time(df, "stream", 3000, 4, 1000, **mode).orderBy("x")
        return [r["smooth"] for r in got.collect()]

    assert any(b < a for a, b in zip(read(), read()[1:]))
    for smoothing in (True, False):
        steady = read(monotonic=True, smoothing=smoothing)
        assert all(b >= a for a, b in zip(steady, steady[1:]))


@pytest.mark.parametrize("gain", [1e-4, 1 / 512, 1 / 16, 0.5, 0.97, 1.0])
def test_smooth_of_any_gain(spark, gain):
    """An exponential mean against a plain loop, over many chunks and groups of chunks."""
    n = 3000 if gain < 0.5 else 1600
    df = spark.range(n).select(
        F.lit(0).alias("k"), F.col("id"), F.when(F.col("id") < 512, 1000.0).otherwise(
            F.when(F.col("id") % 7 == 0, 5.0).otherwise(0.0)).alias("v"),
    )
    got = smooth(ordered(df, ["k"], ["id"]), "v", gain, "m", start=2.0).result().orderBy("id").collect()
    mean = 2.0
    for r in got:
        mean += gain * (r["v"] - mean)
        assert r["m"] == pytest.approx(mean, rel=1e-9, abs=1e-12)


def test_mix_of_unequal_packets(spark):
    rows = [(0, s, 10 * s, s, p) for s, p in enumerate([[1, 2, 3], [10], [], [30000, 30000, 5, 7], None])]
    df = spark.createDataFrame(rows, "channel long, speaker long, us long, event_id long, pcm array<bigint>")
    row = packets.mix_rounds(df).first()
    assert (row["speakers"], list(row["pcm"])) == (5, [30011, 30002, 8, 7])


def test_drift_of_a_straight_line(spark):
    df = spark.range(200).select(
        F.lit(1).cast("bigint").alias("stream"), (F.col("id") * 10).alias("x"),
        (F.col("id") * 15).alias("y"),
    )
    slopes = [r["slope"] for r in series.drift(df, "stream", 300, 5).orderBy("x").collect()]
    assert slopes[:4] == [1.0] * 4
    assert slopes[4:] == pytest.approx([1.5] * 196)
