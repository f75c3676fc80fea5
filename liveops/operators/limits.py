"""Rate limiting of events per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.operators.chains import windows

ARRIVAL = ["us", "event_id"]


def limit_begin() -> dict:
    return {"since": None, "passed": 0}


def limit_step(state: dict, row: dict) -> list[dict]:
    """One event: a window opens with it once the interval is over; burst + 1 pass."""
    now = row["us"]
    if state["since"] is None or state["since"] + row["interval"] < now:
        state.update(since=now, passed=0)
    ok = state["passed"] <= row["burst"]
    if ok:
        state["passed"] += 1
    return [{"us": now, "event_id": row["event_id"], "window_us": state["since"], "passed": ok}]


def rate_limit(df: DataFrame, interval_us: int, burst: int) -> DataFrame:
    """Which events of each ``source`` pass and the window each falls in."""
    rows = windows(df.select("source", *ARRIVAL), "source", interval_us, closed=False)
    return rows.result().select(
        "source", *ARRIVAL, F.col("since").alias("window_us"),
        (F.col("nth") <= burst + 1).alias("passed"),
    )


def suppressed(limited: DataFrame) -> DataFrame:
    """Events held back per source and window."""
    return (
        limited.groupBy("source", "window_us")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("passed")).alias("suppressed"))
    )
