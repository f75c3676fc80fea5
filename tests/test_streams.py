"""Streams run to their end against the batch operators on the same rows."""

import tempfile

import pytest
from pyspark.sql import functions as F

from liveops.operators import channels, keyed, limits, packets, playlist, queues
from liveops.operators import p2p
from liveops.plans import channel_queries, packet_queries
from liveops.plans.fixtures import HOUR, Tables
from liveops.streaming import streams, versioned


@pytest.fixture(scope="module")
def tables(spark, folder):
    return Tables(spark, folder)


def streamed(spark, batch, wrap, files=3):
    """``wrap`` applied to ``batch`` read as a stream of files in arrival order."""
    source = tempfile.mkdtemp(prefix="liveops-in-")
    rows = batch.orderBy("us").coalesce(1).collect()
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], batch.schema)
        part.coalesce(1).write.mode("append").parquet(source)
    stream = (
        spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    )
    name = f"out{abs(hash(source))}"
    query = (
        wrap(stream).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="liveops-cp-"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


def same(a, b, columns):
    def rows(df):
        return sorted(str(tuple(r)) for r in df.select(*columns).collect())

    assert rows(a) == rows(b)
    assert a.count()


def test_rate_limit(spark, tables):
    rows = tables.ticks().select(F.col("user_id").alias("source"), "us", "event_id")
    got = streamed(spark, rows, lambda s: streams.rate_limit(s, 24 * HOUR, 1))
    same(got, limits.rate_limit(rows, 24 * HOUR, 1), ["event_id", "window_us", "passed"])


def test_connections(spark, tables):
    rows = packet_queries.trace(tables)
    got = streamed(spark, rows, streams.connections)
    same(got, packets.connections(rows), ["event_id", "state", "delivered"])


def test_edges_and_status(spark, tables):
    rows = channel_queries.status_signals(tables)
    got = streamed(spark, rows, streams.edges)
    same(got, channels.edges(rows.drop("signal")), ["channel", "event_id", "online"])
    got = streamed(spark, rows, streams.statuses)
    last = keyed.latest(got, "channel", ["us", "event_id"])
    same(last, channels.status(rows), ["channel", "status"])


def test_admissions(spark, tables):
    rows = tables.signals()
    got = streamed(spark, rows, lambda s: streams.admissions(s, 3))
    same(got, channels.admit_live(rows, 3), ["event_id", "http"])


def test_late(spark, tables):
    rows = tables.packets().select("stream", "us", "event_id", "seq")
    got = streamed(spark, rows, lambda s: streams.late(s, HOUR))
    same(got, packets.late(rows, HOUR, "seq"), ["event_id", "too_late"])


def test_mix_rounds(spark, tables):
    rows = packet_queries.speech(tables).withColumn(
        "pcm", F.array(F.col("seq").cast("bigint"), F.col("rtp_ts"))
    )
    got = streamed(spark, rows, lambda s: streams.mix_rounds(s, 6 * HOUR))
    batch = packets.mix_rounds(rows, 6 * HOUR)
    # A channel's last period waits for more of it.
    last = rows.groupBy("channel").agg(F.floor(F.max("us") / (6 * HOUR)).alias("_last"))
    done = batch.join(last, "channel").where(F.col("period") < F.col("_last"))
    same(got, done, ["channel", "period", "round", "speakers", "pcm"])
    got = streamed(spark, rows, lambda s: streams.mix_rounds(s, 6 * HOUR, 0), files=1)
    same(got, batch, ["channel", "period", "round", "speakers", "pcm"])


def test_alerts_without_further_rows(spark):
    """Idle alerts and the rest of a play-out buffer come by time alone."""
    second = 1_000_000
    rows = [
        (1, 10 * second, 0, 1), (1, 11 * second, 1, 2), (2, 12 * second, 2, 1),
        (2, 100 * second, 3, 2),
    ]
    df = spark.createDataFrame(rows, "stream bigint, us bigint, event_id bigint, seq bigint")
    got = streamed(spark, df, lambda s: streams.idle(s, "stream", 5 * second, 0), files=4)
    assert {tuple(r) for r in got.collect()} == {
        (1, 10 * second, 11 * second, 2, 16 * second),
        (2, 12 * second, 12 * second, 1, 17 * second),
        (2, 100 * second, 100 * second, 1, 105 * second),
    }
    played = streamed(spark, df, lambda s: streams.playout(s, 2 * second, second // 2, None, 0), files=4)
    assert {(r.stream, r.useq, r.status) for r in played.collect()} == {
        (1, 1, "played"), (1, 2, "played"), (2, 1, "played"), (2, 2, "played"),
    }


def lagging(rows, key, by_us):
    """``rows`` whose keys of odd number are behind the others, and arrive with them."""
    late = F.col(key) % 2 == 1
    return rows.withColumn("arrives", F.col("us")).withColumn(
        "us", F.when(late, F.col("us") - by_us).otherwise(F.col("us"))
    )


def arrived(spark, batch, wrap, files=5):
    """As ``streamed``, in order of the column ``arrives``."""
    ordered = batch.orderBy("arrives", "event_id").drop("arrives").coalesce(1).collect()
    schema = batch.drop("arrives").schema
    source, size = tempfile.mkdtemp(prefix="liveops-in-"), -(-len(ordered) // files)
    for i in range(files):
        part = spark.createDataFrame(ordered[i * size : (i + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"out{abs(hash(source))}"
    wrap(stream).writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", tempfile.mkdtemp(prefix="liveops-cp-")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_keys_behind_others_keep_every_row(spark, tables):
    """Streams that lag by hours are played and mixed as in the batch; nothing vanishes."""
    packets_ = lagging(tables.packets().select("stream", "us", "event_id", "seq"), "stream", 30 * HOUR)
    got = arrived(spark, packets_, lambda s: streams.playout(s, HOUR, HOUR // 10))
    fates = packets.playout(packets_.drop("arrives"), HOUR, HOUR // 10)
    # What is buffered at the end waits for more of its stream.
    done = got.join(fates, ["stream", "event_id", "status", "out_us"], "left_semi")
    assert done.count() == got.count() > 0
    waiting = fates.join(got, ["stream", "event_id"], "left_anti").groupBy("stream").count()
    assert all(r["count"] <= 20 for r in waiting.collect())
    assert got.where("stream % 2 = 1").count() > 0
    speech = lagging(packet_queries.speech(tables), "channel", 30 * HOUR).withColumn(
        "pcm", F.array(F.col("seq").cast("bigint"), F.col("rtp_ts"))
    )
    got = arrived(spark, speech, lambda s: streams.mix_rounds(s, 6 * HOUR))
    rows = speech.drop("arrives")
    last = rows.groupBy("channel").agg(F.floor(F.max("us") / (6 * HOUR)).alias("_last"))
    batch = packets.mix_rounds(rows, 6 * HOUR).join(last, "channel").where("period < _last")
    same(got, batch, ["channel", "period", "round", "speakers", "pcm"])


def test_backlog(spark, tables):
    kind = F.col("event_type")
    rows = tables.ticks().select(
        (F.col("user_id") % 4).alias("viewer"), "us", "event_id",
        (kind == "purchase").alias("is_key"),
        F.when(kind == "view", (F.col("k") % 4).cast("int")).alias("served"),
    )
    got = streamed(spark, rows, lambda s: streams.backlog(s, 5))
    same(got, queues.backlog(rows, 5), ["viewer", "event_id", "dropped_by"])


def test_chat(spark, tables):
    rows = tables.chat()
    got = streamed(spark, rows, streams.chat)
    from liveops.operators import chat

    same(got, chat.room(rows), ["channel", "us", "speaker", "event", "receivers"])


def test_directory(spark, tables):
    kind = F.col("event_type")
    action = (
        F.when(kind == "signup", "PING").when(kind == "click", "COMMIT")
        .when(kind == "view", "QUERY").when(kind == "purchase", "TRANSFER").otherwise("QUIT")
    )
    rows = tables.ticks().select(
        F.col("user_id").alias("client"), F.col("k").alias("resource"), "us", "event_id",
        action.alias("action"),
    )
    known = streamed(spark, rows, streams.present)
    got = streamed(spark, known, streams.replies)
    same(got, p2p.directory(rows), ["event_id", "reply", "owner"])


def test_anchored_segments(spark, tables):
    rows = tables.frames().select("channel", "us", "event_id")
    got = streamed(spark, rows, lambda s: streams.anchored_segments(s, 3600))
    same(got, playlist.anchored_segments(rows, 3600), ["event_id", "cut", "since_us"])


def test_windows(spark, tables):
    rows = tables.frames().withColumn("ts", F.timestamp_micros("us"))
    got = streamed(spark, rows, lambda s: streams.segments(s, "1 second", 3600))
    batch = rows.groupBy("channel", F.window("ts", "3600 seconds")).agg(
        F.count(F.lit(1)).alias("frames")
    )
    assert 0 < got.count() <= batch.count()
    gap = F.when(F.col("channel") % 7 == 0, "1 hour").otherwise("6 hours")
    got = streamed(spark, rows, lambda s: streams.sessions(s, "channel", gap, "1 second"))
    assert got.where("suspend_ts <= from_ts").count() == 0


def test_published_once(spark, tables):
    rows = tables.snapshots()
    source, out, state = (tempfile.mkdtemp(prefix="liveops-") for _ in range(3))
    rows.write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    for _ in range(2):
        streams.publish_latest(
            stream, "server", ["us", "event_id"], f"{out}/t", state, availableNow=True
        ).awaitTermination()
    got = streams.read_latest(spark, "server", ["us", "event_id"], f"{out}/t")
    same(got, keyed.latest(rows, "server", ["us", "event_id"]), ["server", "event_id", "bytes"])
    query = streams.publish(stream, f"{out}/e", tempfile.mkdtemp(prefix="liveops-"),
                            availableNow=True)
    query.awaitTermination()
    assert spark.read.parquet(f"{out}/e").count() == rows.count()


def test_versions(spark, tmp_path, monkeypatch):
    """Runs are merged by key; a repeated batch adds nothing; readers hold whole generations."""
    monkeypatch.setattr(versioned, "RUNS", 3)
    path, everything = str(tmp_path / "t"), []
    held = None
    for epoch in range(12):
        rows = [(k, 100 * epoch + k, f"{epoch}-{k}") for k in range(epoch % 3, 6)]
        everything += rows
        batch = spark.createDataFrame(rows, "k bigint, us bigint, v string")
        for _ in range(2):
            versioned.append_latest(batch, epoch, "writer", path, "k", ["us"])
        table = versioned.Versioned(spark, path)
        assert len(table.manifest()["runs"]) <= 3
        assert table.read().count() <= 6 * 3
        got = versioned.read_latest(spark, "k", ["us"], path)
        want = {k: v for k, _, v in sorted(everything, key=lambda r: r[1])}
        assert {r.k: r.v for r in got.collect()} == want
        if held is not None:
            # The generation before is still there.
            assert {r.k: r.v for r in held[0].collect()} == held[1]
        held = got, want
    versioned.append_latest(batch, 0, "another writer", path, "k", ["us"])
    # A run that no manifest names, as a write that failed leaves it, is not read.
    before = table.read().count()
    table.add(batch)
    assert versioned.Versioned(spark, path).read().count() == before
    assert len(table.numbers()) <= versioned.HELD
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("run-")]
    assert len(folders) < 12


def test_memberships(spark):
    rows = [
        (0, 1, 0, "CREATE", 1, 1), (0, 1, 5, "JOIN", 2, 2), (0, 2, 5, "JOIN", 3, 3),
        (0, 1, 6, "JOIN", 4, 4), (0, 1, 5, "LEAVE", 5, 5), (0, 1, 0, "CANCEL", 6, 6),
    ]
    df = spark.createDataFrame(
        rows,
        "server bigint, channel bigint, client bigint, action string, us bigint, event_id bigint",
    )
    got = streamed(spark, df, streams.memberships)
    spans = sorted((r.channel, r.client, r.from_us, r.to_us) for r in got.collect())
    assert spans == [(1, 0, 1, 6), (1, 5, 2, 5), (1, 6, 4, 6)]




SIGNALS = "server bigint, channel bigint, client bigint, action string, us bigint, event_id bigint"


def run(stream, name, checkpoint):
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option(
        "path", name
    ).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("key", ["rooms", "servers"])
def test_restart_from_a_checkpoint(spark, tmp_path, key):
    """Members that joined before a restart are there after it."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    if key == "rooms":
        schema, wrap = "channel bigint, speaker string, us bigint, text string", streams.chat
        parts = [
            [(1, "a", 1, "hi"), (1, "b", 2, "hi"), (2, "a", 3, "hi"), (1, None, 3, None)],
            [(1, "a", 4, "quit"), (1, "a", 5, "quit"), (1, "b", 6, "on"), (2, "c", 7, "hi")],
        ]
        want = [(1, "join", 1), (2, "join", 2), (3, "join", 1), (3, "join", 3), (4, "quit", 3),
                (5, "quit", 2), (6, "say", 2), (7, "join", 2)]
        columns = ["us", "event", "receivers"]
    else:
        schema, wrap = SIGNALS, streams.memberships
        parts = [
            [(0, 1, 0, "CREATE", 1, 1), (0, 1, 5, "JOIN", 2, 2), (0, 2, 6, "CREATE", 3, 3)],
            [(0, 1, 5, "LEAVE", 4, 4), (0, 1, 6, "JOIN", 5, 5), (0, 1, 0, "CANCEL", 6, 6),
             (0, 1, 7, "JOIN", 7, 7), (0, 2, 6, "LEAVE", 8, 8), (0, 2, 6, "LEAVE", 9, 9)],
        ]
        want = [(0, 1, 6), (5, 2, 4), (6, 3, 8)]
        columns = ["client", "from_us", "to_us"]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        run(wrap(spark.readStream.schema(schema).parquet(source)), out, checkpoint)
    got = spark.read.parquet(out).select(*columns).collect()
    assert sorted(map(tuple, got)) == want


def test_silent_keys_are_forgotten(spark):
    """The state of a room, a channel and a server goes once nothing of it arrives."""
    rows = [(1, "a", 1, "hi"), (2, "x", 2, "hi"), (2, "y", 3, "hi"), (2, "x", 4, "hi"), (1, "b", 5, "hi")]
    df = spark.createDataFrame(rows, "channel bigint, speaker string, us bigint, text string")
    got = streamed(spark, df, lambda s: streams.chat(s, 0), files=5)
    assert sorted((r.us, r.receivers) for r in got.collect())[-1] == (5, 1)
    held = streamed(spark, df, lambda s: streams.chat(s, 3_600_000_000), files=5)
    assert sorted((r.us, r.receivers) for r in held.collect())[-1] == (5, 2)
    signals = [(0, 1, 0, "CREATE", 1, 1), (1, 2, 0, "CREATE", 2, 2), (1, 2, 1, "JOIN", 3, 3),
               (1, 2, 2, "JOIN", 4, 4), (0, 1, 5, "JOIN", 5, 5)]
    spans = streamed(
        spark, spark.createDataFrame(signals, SIGNALS), lambda s: streams.memberships(s, "server", 0), files=5
    )
    found = {(r.server, r.client, r.from_us, r.to_us) for r in spans.collect()}
    assert (0, 0, 1, None) in found and not any(client == 5 for _, client, *_ in found)
