"""Admission of streaming requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.functions.text import request_line
from liveops.operators.ordered import latest, ordered, total

# Longest channel name, channels per server and viewers per channel.
CHANNEL_LENGTH, CHANNELS_LIMIT, VIEWERS_LIMIT = 32, 100, 2000


def parse(df: DataFrame, line: str = "line") -> DataFrame:
    """Columns method, path, channel, src and version of each request line."""
    return df.withColumn("_r", request_line(line)).select(
        *df.columns, F.col("_r.method").alias("method"), F.col("_r.path").alias("path"),
        F.try_element_at("_r.args", F.lit("channel")).alias("channel"),
        F.try_element_at("_r.args", F.lit("src")).alias("src"),
        F.col("_r.version").alias("version"),
    )


def route(df: DataFrame, channels_limit: int = CHANNELS_LIMIT,
          viewers_limit: int = VIEWERS_LIMIT, order=("us", "event_id")) -> DataFrame:
    """Reply to each request of a ``server`` in order: 200, 400, 404, 503.

    A POST publishes a channel; a GET views one, and with a ``src`` it opens an
    unknown channel as a relay. Limits are compared with ``>``: one more gets in.
    """
    channel = F.coalesce("channel", F.lit(""))
    good = (
        (channel != "") & (F.length(channel) <= CHANNEL_LENGTH)
        & F.coalesce(F.col("method").isin("GET", "POST"), F.lit(False))
    )
    post = F.col("method") == "POST"
    source = F.coalesce("src", F.lit("")) != ""
    rows = df.withColumns({"_good": good, "_opens": good & (post | source)})
    count = F.lit(0).cast("bigint")
    by_channel = ordered(rows, ["server", "channel"], order).running(
        _tries=total(F.col("_opens").cast("bigint"))
    )
    first = by_channel.map({"_first": F.col("_opens") & (F.col("_tries") == 1)}).result()
    by_server = ordered(first, ["server"], order).running(
        _open=total(F.col("_first").cast("bigint"), inclusive=False)
    )
    full = F.coalesce("_open", count) > channels_limit
    judged = by_server.map({"_full": full, "_opened": F.col("_first") & ~full}).result()
    again = ordered(judged, ["server", "channel"], order).running(
        _known=latest(F.when(F.col("_opened"), True), inclusive=False)
    )
    known = F.coalesce("_known", F.lit(False))
    again = again.map({"_views": F.col("_good") & ~post & known}).running(
        _viewers=total(F.col("_views").cast("bigint"), inclusive=False)
    )
    crowded = F.coalesce("_viewers", count) > viewers_limit
    http = (
        F.when(~F.col("_good"), 400)
        .when(post & F.col("_full"), 503)
        .when(post & known, 400)
        .when(post, 200)
        .when(known & crowded, 503)
        .when(known, 200)
        .when(~source, 404)
        .when(F.col("_full"), 503)
        .otherwise(200)
    )
    relayed = F.col("_good") & ~post & ~known & source & ~F.col("_full")
    return again.map({"http": http, "relayed": relayed}).result().select(
        *df.columns, "http", "relayed"
    )


def rtmp_accept(df: DataFrame, app: str, max_len: int) -> DataFrame:
    """Commands for the application whose stream name is not too long."""
    ok = (F.col("app") == app) & (F.length("stream_name") <= max_len)
    return df.withColumn("accepted", F.coalesce(ok, F.lit(False)))
