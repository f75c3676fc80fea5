"""Who is in which channel when: signals, intervals, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveops.operators.joins import during
from liveops.operators.ordered import following, ordered, previous, total
from liveops.operators.replay import composed

TYPES = ("CAMERA", "PC")
ACTIONS = ("CREATE", "JOIN", "LEAVE", "CANCEL")


def parse_signal(text) -> Column:
    """``TYPE_ACTION_channel_epoch[_uid]`` as a struct; null when not of that form."""
    part = F.split(text, "_")
    valid = (
        (F.size(part) >= 4) & F.get(part, F.lit(0)).isin(*TYPES)
        & F.get(part, F.lit(1)).isin(*ACTIONS)
    )
    return F.when(
        valid,
        F.struct(
            F.get(part, F.lit(0)).alias("type"),
            F.get(part, F.lit(1)).alias("action"),
            F.get(part, F.lit(2)).alias("channel"),
            F.get(part, F.lit(3)).try_cast("bigint").alias("epoch"),
            F.get(part, F.lit(4)).alias("uid"),
        ),
    )


def format_signal(kind, action, channel, epoch, uid=None) -> Column:
    """Text of a signal; a null uid is left out."""
    parts = [kind, action, channel, epoch] + ([uid] if uid is not None else [])
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def spells(signals: DataFrame, keys, opens: Column, closes: Column, at="us", tie="event_id"):
    """Spans from an opening row to the next closing row of a key; repeats are no-ops."""
    keys = list(keys)
    marked = signals.withColumn("_open", F.when(opens, True).when(closes, False))
    rows = ordered(marked.where(F.col("_open").isNotNull()), keys, [at, tie])
    rows = rows.running(_was=previous("_open"))
    edges = rows.df.where(
        F.col("_open") != F.coalesce(F.col("_was"), F.lit(False))
    )
    # Blocks stay valid: dropping rows keeps the order within and across them.
    rows = type(rows)(edges, rows.keys, rows.order, rows.blocks).running(
        to_us=following(at), to_id=following(tie)
    )
    return rows.df.where("_open").select(
        *keys, F.col(at).alias("from_us"), "to_us", F.col(tie).alias("from_id"), "to_id"
    )


def intervals(signals: DataFrame) -> DataFrame:
    """Membership spans of (channel, client) from JOIN and LEAVE alone."""
    action = F.col("action")
    return spells(signals, ["channel", "client"], action == "JOIN", action == "LEAVE")


def _begin():
    return {"channel": None, "until": None, "since": None, "since_id": None}


def member_step(state: dict, row: dict) -> list[dict]:
    """One client's JOIN or LEAVE; ``alive_until`` is when the row's channel is cancelled.

    A client is in one channel at most. A join while in is ignored, a leave
    naming another channel leaves the membership as it is.
    """
    out = []
    at = row["us"]
    if state["channel"] is not None and state["until"] is not None and state["until"] <= at:
        out.append(_spell(state, state["until"]))
        state.update(_begin())
    if row["action"] == "JOIN" and row["alive"] and state["channel"] is None:
        state.update(
            channel=row["channel"], until=row["alive_until"], since=at, since_id=row["event_id"]
        )
    elif row["action"] == "LEAVE" and state["channel"] == row["channel"]:
        out.append(_spell(state, at))
        state.update(_begin())
    return out


def _spell(state, end):
    return {
        "channel": state["channel"], "from_us": state["since"], "to_us": end,
        "from_id": state["since_id"],
    }


def member_finish(state: dict) -> list[dict]:
    return [_spell(state, state["until"])] if state["channel"] is not None else []


class Member:
    """The machine of a client; who enters a block inside is one of two open classes.

    A client inside is out again when the channel ends (``upto``) or by a LEAVE of the channel,
    whichever is first; nothing else changes for them.
    """

    begin, step, finish = staticmethod(_begin), staticmethod(member_step), staticmethod(member_finish)

    def freeze(self, state):
        if state["channel"] is None:
            return None
        return [state["channel"], state["until"], state["since"], state["since_id"]]

    def thaw(self, frozen):
        return _begin() if frozen is None else dict(zip(("channel", "until", "since", "since_id"), frozen))

    def known(self):
        return [None]

    def before(self, opened, row):
        if opened.get("upto") == row["us"]:
            return []
        opened["upto"] = row["us"]
        return [({"upto": row["us"]}, None)]

    def after(self, opened, row):
        left = opened.setdefault("left", set())
        if row["action"] != "LEAVE" or row["channel"] in left:
            return []
        left.add(row["channel"])
        return [({"channel": row["channel"]}, None)]

    def matches(self, kind, frozen):
        if frozen is None:
            return False
        channel, until = frozen[:2]
        return kind["channel"] == channel if "channel" in kind else until is not None and until <= kind["upto"]


def machine(signals: DataFrame) -> DataFrame:
    """Membership spans under CREATE, JOIN, LEAVE and CANCEL.

    Who opens a channel is its first member, unless a member elsewhere. Channel lifetimes come from an ordered pass per channel and are attached to
    the joins as of their time; the rest is one small state per client.
    """
    action = F.col("action")
    lives = spells(signals, ["channel"], action == "CREATE", action == "CANCEL")
    client_rows = signals.where(action.isin("JOIN", "LEAVE", "CREATE")).select(
        "channel", "us", "event_id", "client", "action"
    )
    known = during(
        client_rows, lives, ["channel"], "us", "event_id", ["from_id"], "from_us", "to_us",
        outer=True,
    ).withColumn("alive", F.col("from_us").isNotNull()).withColumnRenamed("to_us", "alive_until")
    opened = (action == "CREATE") & F.col("from_id").eqNullSafe(F.col("event_id"))
    known = known.where((action != "CREATE") | opened).withColumn(
        "action", F.when(opened, "JOIN").otherwise(action)
    )
    return composed(
        known.select("client", "channel", "action", "us", "event_id", "alive", "alive_until"),
        ["client"],
        ["us", "event_id"],
        Member(),
        "client bigint, channel bigint, from_us bigint, to_us bigint, from_id bigint",
    )


def authorised(packets: DataFrame, spans: DataFrame, outer: bool = False) -> DataFrame:
    """Packets whose sender is a member then; ``outer`` keeps the rest with null channel."""
    return during(
        packets, spans, ["client"], "us", "event_id", ["channel"], "from_us", "to_us", outer
    )


def channel_of(clients: DataFrame, spans: DataFrame) -> DataFrame:
    """Channel each client is in now: its open span."""
    return clients.join(
        spans.where(F.col("to_us").isNull()).select("client", "channel"), "client", "left"
    )


def fanout(messages: DataFrame, members: DataFrame, include_self: bool = False) -> DataFrame:
    """One row per message and receiving member of its channel.

    The result is as large as the deliveries; ask ``fanout_counts`` for totals.
    """
    pairs = messages.join(members.withColumnRenamed("client", "member"), "channel")
    return pairs if include_self else pairs.where(F.col("member") != F.col("sender"))


def fanout_counts(messages: DataFrame, spans: DataFrame, include_self: bool = False) -> DataFrame:
    """Receivers of each message: members of its channel at that time, without forming pairs."""
    rest = [c for c in messages.columns if c not in ("channel", "us", "event_id")]
    moves = steps(spans).select(
        "channel", "us", "event_id", F.lit(0).alias("_side"), F.col("step").alias("_n")
    )
    sent = messages.select(
        "channel", "us", "event_id", F.lit(1).alias("_side"), F.struct(*rest).alias("_m")
    )
    rows = ordered(
        moves.unionByName(sent, allowMissingColumns=True), ["channel"], ["us", "event_id", "_side"]
    ).running(members=total(F.coalesce(F.col("_n"), F.lit(0).cast("bigint"))))
    out = rows.df.where(F.col("_side") == 1).select(
        "channel", "us", "event_id", *[f"_m.{c}" for c in rest], "members"
    )
    if include_self:
        return out.withColumnRenamed("members", "receivers")
    inside = during(
        out.withColumn("client", F.col("sender")), spans, ["channel", "client"], "us",
        "event_id", [], "from_us", "to_us", outer=True,
    )
    own = F.col("from_us").isNotNull().cast("bigint")
    return inside.select(*out.columns, (F.col("members") - own).alias("receivers")).drop("members")


def steps(spans: DataFrame) -> DataFrame:
    """+1 where a span begins and -1 where it ends."""
    begin = spans.select(
        "channel", F.col("from_us").alias("us"), F.col("from_id").alias("event_id"),
        F.lit(1).cast("bigint").alias("step"),
    )
    end = spans.where(F.col("to_us").isNotNull()).select(
        "channel", F.col("to_us").alias("us"), F.col("to_id").alias("event_id"),
        F.lit(-1).cast("bigint").alias("step"),
    )
    return begin.unionByName(end)

