"""Chat rooms: history, and the lines a room sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.functions.text import chat_line
from liveops.operators import keyed
from liveops.operators.ordered import ordered, previous, total


def history(df: DataFrame, tie) -> DataFrame:
    """First message per channel and time."""
    return keyed.first(df, ["channel", "us"], tie)


def room(df: DataFrame) -> DataFrame:
    """What each message does (join, say, quit, close), its line, and how many receive it.

    A message of a speaker who is not in joins the room. The room's members then,
    a speaker who quits too, receive the line; who is not in cannot leave.
    """
    leaves = F.when(F.col("text") == "quit", "quit").when(
        F.ascii(F.col("text")) == 3, "close"
    )
    rows = ordered(df.withColumn("_leaves", leaves), ["channel", "speaker"], ["us", "text"]).running(
        _before=previous(F.coalesce("_leaves", F.lit("")))
    )
    inside = F.coalesce(F.col("_before") == "", F.lit(False))
    event = F.coalesce("_leaves", F.when(inside, "say").otherwise("join"))
    rows = rows.map({"event": event, "_inside": inside}).result("_before", "_leaves")
    joined = (F.col("event") == "join").cast("bigint")
    left = (F.col("event").isin("quit", "close") & F.col("_inside")).cast("bigint")
    counted = ordered(rows, ["channel"], ["us", "speaker", "text"]).running(
        _in=total(joined), _out=total(left, inclusive=False)
    )
    when = F.date_format(F.timestamp_seconds("us"), "yyyy/MM/dd HH:mm:ss")
    return counted.map(
        {
            "receivers": F.col("_in") - F.coalesce("_out", F.lit(0).cast("bigint")),
            "line": chat_line(when, "speaker", "event", "text"),
        }
    ).result("_in", "_out", "_inside", "text")
