"""Channel lists, viewer counts, concurrency, admission and status."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.operators import keyed
from liveops.operators.membership import steps
from liveops.operators.numbered import numbered
from liveops.operators.ordered import following, ordered, position, previous, total
from liveops.operators.replay import Steps, coupled


def all_channels(cameras: DataFrame, relays: DataFrame) -> DataFrame:
    """Cameras and relays in one list, duplicates kept."""
    return cameras.withColumn("is_camera", F.lit(True)).unionByName(
        relays.withColumn("is_camera", F.lit(False))
    )


def summary(channels: DataFrame) -> DataFrame:
    """Totals by kind and the set of channels, per server.

    A server's set is bounded by its admission limit, so it fits one row.
    """
    name = F.col("channel").cast("string")
    camera = F.col("kind") == "camera"
    return channels.groupBy("server").agg(
        F.count_distinct("channel").alias("total"),
        F.count_distinct(F.when(camera, F.col("channel"))).alias("cameras"),
        F.count_distinct(F.when(~camera, F.col("channel"))).alias("resources"),
        F.array_join(F.sort_array(F.collect_set(name)), ",").alias("channel_set"),
    )


def viewers(channels: DataFrame, spans: DataFrame) -> DataFrame:
    """Viewers now per channel; a relay counts half its sockets."""
    now = (
        spans.where(F.col("to_us").isNull())
        .groupBy("channel")
        .agg(F.count(F.lit(1)).alias("sockets"))
    )
    sockets = F.coalesce(F.col("sockets"), F.lit(0))
    return channels.join(now, "channel", "left").select(
        "channel",
        "kind",
        F.when(F.col("kind") == "camera", sockets).otherwise(F.expr("coalesce(sockets, 0) div 2"))
        .cast("bigint")
        .alias("viewers"),
    )


def online(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("viewers").alias("online"))


def concurrency(spans: DataFrame) -> DataFrame:
    """Members of each channel after every change."""
    rows = ordered(steps(spans), ["channel"], ["us", "event_id", "step"])
    return rows.running(members=total("step")).result()


def peak(spans: DataFrame) -> DataFrame:
    return concurrency(spans).groupBy("channel").agg(F.max("members").alias("peak"))


def _allowed(limit: int, inclusive_overflow: bool) -> int:
    return limit + 1 if inclusive_overflow else limit


def admit(arrivals: DataFrame, limit: int, inclusive_overflow: bool = True) -> DataFrame:
    """Status 200 for the first arrivals of a channel, 503 beyond the limit.

    The size is compared with ``>``, so one more than the limit gets in.
    """
    rows = ordered(arrivals, ["channel"], ["us", "event_id"]).running(_n=position())
    ok = F.col("_n") <= _allowed(limit, inclusive_overflow)
    return rows.map({"http": F.when(ok, 200).otherwise(503)}).result("_n")


def full_begin():
    return {"inside": set()}


def admit_step(state: dict, row: dict) -> list[dict]:
    inside = state["inside"]
    if row["action"] == "LEAVE":
        inside.discard(row["client"])
        return []
    if row["client"] in inside:
        status = 500
    elif len(inside) >= row["allowed"]:
        status = 503
    else:
        inside.add(row["client"])
        status = 200
    return [{"client": row["client"], "us": row["us"], "event_id": row["event_id"],
             "http": status}]


ADMISSION = Steps(
    full_begin, admit_step,
    freeze=lambda state: sorted(state["inside"]), thaw=lambda frozen: {"inside": set(frozen)},
)


def admit_live(signals: DataFrame, limit: int, inclusive_overflow: bool = True) -> DataFrame:
    """Admission where leaving viewers free their place.

    Whoever is admitted also asked, so a channel nobody asks for is empty: its
    rows are cut there into stretches that run independently. A long stretch is run in blocks,
    from nobody inside and from who the block before leaves inside, until both runs agree.
    """
    step = F.when(F.col("action") == "JOIN", 1).otherwise(-1).cast("bigint")
    rows = ordered(
        signals.withColumn("_step", step), ["channel", "client"], ["us", "event_id"]
    ).running(_was=previous("_step"))
    change = F.when(F.col("_step") == F.coalesce("_was", F.lit(-1)), 0).otherwise(F.col("_step"))
    by_channel = ordered(
        rows.map({"_change": change.cast("bigint")}).result(), ["channel"], ["us", "event_id"]
    ).running(_asked=total("_change"))
    stretched = by_channel.running(
        stretch=total(F.when(F.col("_asked") == 0, 1).otherwise(0).cast("bigint"), inclusive=False)
    ).map({"stretch": F.coalesce("stretch", F.lit(0).cast("bigint"))})
    return coupled(
        stretched.df.select("channel", "stretch", "client", "action", "us", "event_id").withColumn(
            "allowed", F.lit(_allowed(limit, inclusive_overflow))
        ),
        ["channel", "stretch"],
        ["us", "event_id"],
        ADMISSION,
        "channel bigint, client bigint, us bigint, event_id bigint, http int",
    )


def assign(df: DataFrame, order, workers: int = 8) -> DataFrame:
    """Round-robin worker per row in global order."""
    return numbered(df, order, "_n").withColumn(
        "worker", (F.col("_n") % workers).cast("int")
    ).drop("_n")


ONLINE, OVER, FAILED = 1, 2, 3


def status(signals: DataFrame) -> DataFrame:
    """Stored status per channel: 0 sets 1, 1 sets 3, and 2 is never left.

    ``signal`` 2 marks the channel as over.
    """
    code = (
        F.when(F.col("signal") == 0, ONLINE).when(F.col("signal") == 1, FAILED).otherwise(OVER)
    )
    marked = signals.withColumn("_code", code)
    over = F.min(F.when(F.col("_code") == OVER, F.struct("us", "event_id"))).alias("_over")
    last = F.max_by("_code", F.struct("us", "event_id")).alias("_last")
    return marked.groupBy("channel").agg(over, last).select(
        "channel",
        F.when(F.col("_over").isNotNull(), OVER).otherwise(F.col("_last")).cast("int").alias("status"),
    )


def edges(signals: DataFrame) -> DataFrame:
    """Changes between online and offline per channel and how long each lasted."""
    rows = ordered(signals, ["channel"], ["us", "event_id"]).running(_was=previous("online"))
    changed = rows.df.where(F.col("_was").isNull() | (F.col("_was") != F.col("online")))
    out = replace(rows, df=changed).running(_next=following("us"))
    return out.map({"lasted_us": F.col("_next") - F.col("us")}).result("_was", "_next")


def current(signals: DataFrame) -> DataFrame:
    return keyed.latest(signals, ["channel"], ["us", "event_id"])

