"""Bounded viewer queues."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.operators.ordered import lowest, ordered, total
from liveops.operators.replay import Steps, coupled

ARRIVAL = ["us", "event_id"]
# Fixed value: frames queued per viewer.
CAPACITY = 79


def queue_begin() -> dict:
    return {"queue": deque()}


def queue_step(state: dict, row: dict) -> list[dict]:
    """Frames arrive (``is_key`` set) or ``served`` of them leave.

    A full queue drops its oldest frame that is no key frame, else its head.
    """
    queue, out = state["queue"], []
    if row["served"] is not None:
        for _ in range(min(row["served"], len(queue))):
            queue.popleft()
        return out
    if len(queue) >= row["capacity"]:
        drop = next((i for i, (_, key) in enumerate(queue) if not key), 0)
        out.append({"event_id": queue[drop][0], "dropped_by": row["event_id"]})
        del queue[drop]
    queue.append((row["event_id"], row["is_key"]))
    return out


QUEUE = Steps(
    queue_begin, queue_step,
    freeze=lambda state: list(state["queue"]), thaw=lambda frozen: {"queue": deque(map(tuple, frozen))},
)


def backlog(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Frames dropped from each ``viewer``'s queue and the arrival that pushed them out.

    ``rows`` hold arrivals (``is_key``) and services (``served`` frames) in order.
    A queue without a bound is never shorter, so wherever that one, found by
    running sums, is empty, the bounded one is too: rows are cut there, and where
    a whole queue's worth is served at once. A queue that never empties is run in blocks, from
    empty and from what the block before leaves, until both runs hold the same frames.
    """
    step = F.when(F.col("served").isNull(), F.lit(1)).otherwise(-F.col("served")).cast("bigint")
    timed = ordered(rows.withColumn("_step", step), ["viewer"], ARRIVAL).running(_sum=total("_step"))
    timed = timed.running(_low=lowest("_sum"))
    zero = F.lit(0).cast("bigint")
    empty = (F.col("_sum") <= F.least(zero, F.col("_low"))) | F.coalesce(
        F.col("served") >= capacity, F.lit(False)
    )
    timed = timed.map({"_empty": empty.cast("bigint")}).running(
        piece=total("_empty", inclusive=False)
    )
    return coupled(
        timed.df.select(
            "viewer", F.coalesce("piece", zero).alias("piece"), *ARRIVAL, "is_key", "served",
            F.lit(capacity).alias("capacity"),
        ),
        ["viewer", "piece"], ARRIVAL, QUEUE,
        "viewer bigint, event_id bigint, dropped_by bigint",
        # Pieces rise with the arrivals, so the parts need no running sums.
        along=(rows, ["viewer", *ARRIVAL]),
    )
