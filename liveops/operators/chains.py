"""Windows that open with a row and stay open for a fixed span, per key.

Where a window opens depends on the one before, yet only through its time. So
each stretch of time is run for every time the window before could have left
off, the few outcomes are chained, and the stretches are run again in parallel.
"""

from __future__ import annotations

from collections import deque
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.operators.fold import fold
from liveops.operators.ordered import (
    BLOCK, Ordered, latest, ordered, position, previous, total,
)

# Spans per stretch of time.
STRETCH = 64


def _over(since: int, row: dict) -> bool:
    """Whether a row comes after the window opened at ``since``."""
    passed = row["us"] - since
    return passed >= row["span"] if row["closed"] else passed > row["span"]


def open_begin() -> dict:
    return {"since": None}


def open_step(state: dict, row: dict) -> list[dict]:
    """Emit the time of each opening; ``before`` is the opening a stretch starts from."""
    if state["since"] is None:
        state["since"] = row["before"]
    if state["since"] is None or _over(state["since"], row):
        state["since"] = row["us"]
        return [{"us": row["us"]}]
    return []


def race_begin() -> dict:
    return {"chains": deque(), "limit": None, "past": False}


def race_step(state: dict, row: dict) -> list[dict]:
    """Advance all chains that could be running; those that open together are one from then on.

    A chain is the time it opened last and the ranges of first openings that
    lead to it. A stretch is entered within its first span, or else at its first
    row after that.
    """
    us, chains = row["us"], state["chains"]
    if state["limit"] is None:
        state["limit"] = row["stretch"] * row["span"] * STRETCH + row["span"]
    led = []
    while chains and _over(chains[0][0], row):
        led += chains.popleft()[1]
    if us <= state["limit"] or not state["past"]:
        state["past"] = us > state["limit"]
        led.append((us, us))
    if led:
        chains.append((us, led))
    return []


def race_finish(state: dict) -> list[dict]:
    """Ranges of first openings with the last opening they lead to, in order of time."""
    ranges = sorted((low, high, since) for since, led in state["chains"] for low, high in led)
    out = []
    for low, high, since in ranges:
        if out and out[-1]["last"] == since:
            out[-1]["high"] = high
        else:
            out.append({"high": high, "last": since})
    return out


def walk_begin() -> dict:
    return {"since": None, "done": None}


def walk_step(state: dict, row: dict) -> list[dict]:
    """Chain the stretches: the first opening is the first row after the window before."""
    if row["stretch"] == state["done"]:
        return []
    before = state["since"]
    if before is not None and not _over(before, row | {"us": row["high"]}):
        return []
    state.update(since=row["last"], done=row["stretch"])
    return [{"stretch": row["stretch"], "before": before}]


def openings(df: DataFrame, key: str, span_us: int, closed: bool) -> DataFrame:
    """Times (key, us) at which windows open; ``closed`` if one may open exactly a span later.

    Only distinct times matter, so rows are reduced to them first. After a silence
    of more than a span the next row opens a window whatever came before: keys
    of usual size are cut there. With larger keys, stretches of 64 spans are
    raced, chained and replayed; their rows are bounded by the clock's resolution.
    """
    times = df.select(key, "us").distinct()
    rows = ordered(times, [key], ["us"])
    common = {"span": F.lit(span_us).cast("bigint"), "closed": F.lit(closed)}
    unknown = F.lit(None).cast("bigint")
    made = f"{key} bigint, us bigint"
    if not rows.blocks:
        return _cut(rows, key, span_us, common | {"before": unknown}, made)
    usual = replace(rows, df=rows.df.where(F.col(BLOCK) < 0).drop(BLOCK), blocks=0)
    staged = rows.df.where(F.col(BLOCK) >= 0).drop(BLOCK).withColumns(
        common | {"stretch": F.floor(F.col("us") / F.lit(span_us * STRETCH)).cast("bigint")}
    )
    raced = fold(
        staged, [key, "stretch"], ["us"], race_begin, race_step,
        f"{key} bigint, stretch bigint, high bigint, last bigint", race_finish,
    )
    entered = fold(
        raced.withColumns(common), [key], ["stretch", "high"], walk_begin, walk_step,
        f"{key} bigint, stretch bigint, before bigint",
    )
    replayed = fold(
        staged.join(entered, [key, "stretch"]), [key, "stretch"], ["us"], open_begin, open_step,
        made,
    )
    return replayed.unionByName(
        _cut(usual, key, span_us, common | {"before": unknown}, made)
    )


def _cut(rows: Ordered, key: str, span_us: int, settings: dict, made: str) -> DataFrame:
    """Openings of keys of usual size, cut at silences."""
    rows = rows.running(_us=previous("us"))
    fresh = F.col("_us").isNull() | (F.col("us") - F.col("_us") > span_us)
    rows = rows.map({"_fresh": fresh.cast("bigint")}).running(piece=total("_fresh"))
    ready = rows.df.select(key, "piece", "us").withColumns(settings)
    return fold(ready, [key, "piece"], ["us"], open_begin, open_step, made)


def windows(df: DataFrame, key: str, span_us: int, closed: bool) -> Ordered:
    """Rows in order with ``since``, when their window opened, and ``nth``, their place in it."""
    rest = [c for c in df.columns if c not in (key, "us", "event_id")]
    body = df.select(
        key, "us", F.lit(1).alias("_side"), "event_id", F.struct(F.lit(1), *rest).alias("_row")
    )
    opened = openings(df, key, span_us, closed).withColumns(
        {"_side": F.lit(0), "event_id": F.lit(0).cast("bigint")}
    )
    opens = F.col("_side") == 0
    rows = ordered(
        body.unionByName(opened, allowMissingColumns=True), [key], ["us", "_side", "event_id"]
    ).running(_n=position(), since=latest(F.when(opens, F.col("us"))))
    rows = rows.running(_first=latest(F.when(opens, F.col("_n"))))
    kept = rows.df.where(~opens).select(
        key, "us", "event_id", *[f"_row.{c}" for c in rest], "since",
        (F.col("_n") - F.col("_first")).alias("nth"),
        *([c for c in rows.parts if c != key]),
    )
    return Ordered(kept, (key,), ("us", "event_id"), rows.blocks)
