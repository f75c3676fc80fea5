"""Streaming forms of the keyed operators. Event time is the timestamp column ``ts``."""

from __future__ import annotations

import bisect
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveops.operators import channels, keyed, limits, packets, playlist, queues
from liveops.streaming import versioned
from liveops.streaming.stateful import stream_fold

ORDER = ["us", "event_id"]


# membership -----------------------------------------------------------------------------
def room_begin() -> dict:
    return {"open": 0, "rooms": {}, "of": {}}


def _close(state, client, us):
    channel, since, since_id = state["of"].pop(client)
    return {"channel": channel, "client": client, "from_us": since, "to_us": us, "from_id": since_id}


def room_step(state: dict, row: dict) -> list[dict]:
    """CREATE, JOIN, LEAVE and CANCEL of one server; emits spans as they end.

    Who opens a channel is its first member. A client is in one channel at most;
    repeats and requests for unknown channels change nothing.
    """
    rooms, of, channel, client = state["rooms"], state["of"], row["channel"], row["client"]
    action, us = row["action"], row["us"]
    opened = channel in rooms
    if action == "CREATE" and not opened:
        rooms[channel] = us
        state["open"] += 1
    elif action == "CANCEL" and opened:
        gone = sorted(c for c, (inside, *_) in of.items() if inside == channel)
        rooms.pop(channel)
        state["open"] -= 1
        return [_close(state, c, us) for c in gone]
    elif action == "LEAVE" and opened and client in of and of[client][0] == channel:
        return [_close(state, client, us)]
    if client not in of and (action == "JOIN" and opened or action == "CREATE" and not opened):
        of[client] = (channel, us, row["event_id"])
    return []


def room_finish(state: dict) -> list[dict]:
    return [_close(state, c, None) for c in sorted(c for c, _ in state["of"].items())]


SPANS = "server bigint, channel bigint, client bigint, from_us bigint, to_us bigint, from_id bigint"


def memberships(signals: DataFrame, key: str = "server", patience_us: int | None = None) -> DataFrame:
    """Ended membership spans; a server's channels and members are entries of its state.

    With ``patience_us`` a server of which nothing arrives for so long is forgotten: its open
    spans come out without an end, and later signals find no channel.
    """
    return stream_fold(
        signals, [key], ORDER, room_begin, room_step, SPANS, "open bigint",
        {"rooms": ("channel bigint", "since bigint"),
         "of": ("client bigint", "channel bigint, from_us bigint, from_id bigint")},
        finish=lambda state: (room_finish(state), None), patience_us=patience_us,
    )


# channels -------------------------------------------------------------------------------
def status_begin() -> dict:
    return {"status": None}


def status_step(state: dict, row: dict) -> list[dict]:
    """Stored status: 0 sets online, 1 failed, 2 over for good; emits changes."""
    code = {0: channels.ONLINE, 1: channels.FAILED}.get(row["signal"], channels.OVER)
    if state["status"] in (channels.OVER, code):
        return []
    state["status"] = code
    return [{"us": row["us"], "event_id": row["event_id"], "status": code}]


def _forget(state: dict) -> tuple:
    return [], None


def statuses(signals: DataFrame, patience_us: int | None = None) -> DataFrame:
    """Changes of status; a channel silent for ``patience_us`` is forgotten and begins anew."""
    return stream_fold(
        signals, ["channel"], ORDER, status_begin, status_step,
        "channel bigint, us bigint, event_id bigint, status int", "status int",
        finish=_forget, patience_us=patience_us,
    )


def edge_begin() -> dict:
    return {"online": None, "since": None}


def edge_step(state: dict, row: dict) -> list[dict]:
    """A notification per change between online and offline, with the time before it."""
    if state["online"] == row["online"]:
        return []
    before = None if state["since"] is None else row["us"] - state["since"]
    state.update(online=row["online"], since=row["us"])
    return [{"us": row["us"], "event_id": row["event_id"], "online": row["online"],
             "before_us": before}]


def edges(signals: DataFrame, patience_us: int | None = None) -> DataFrame:
    """Changes of presence; a channel silent for ``patience_us`` is forgotten and begins anew."""
    return stream_fold(
        signals, ["channel"], ORDER, edge_begin, edge_step,
        "channel bigint, us bigint, event_id bigint, online boolean, before_us bigint",
        "online boolean, since bigint", finish=_forget, patience_us=patience_us,
    )


def publish(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Write each micro-batch to its own folder; a repeated batch replaces it, so rows come once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def publish_latest(snapshots: DataFrame, key: str, order, path: str, checkpoint: str, **trigger):
    """Every five seconds add the batch's latest row per key; read with ``read_latest``."""

    def write(batch: DataFrame, epoch: int) -> None:
        versioned.append_latest(batch, epoch, checkpoint, path, key, order)

    return (
        snapshots.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


read_latest = versioned.read_latest


def admissions(signals: DataFrame, limit: int, inclusive_overflow: bool = True) -> DataFrame:
    allowed = F.lit(limit + 1 if inclusive_overflow else limit)
    return stream_fold(
        signals.withColumn("allowed", allowed), ["channel"], ORDER,
        channels.full_begin, channels.admit_step,
        "channel bigint, client bigint, us bigint, event_id bigint, http int",
        "inside array<bigint>",
    )


# chat -----------------------------------------------------------------------------------
def chat_begin() -> dict:
    return {"count": 0, "members": {}}


def chat_step(state: dict, row: dict) -> list[dict]:
    """What a message does and how many of the room receive it."""
    members, speaker, text = state["members"], row["speaker"], row["text"] or ""
    event = "quit" if text == "quit" else "close" if text[:1] == "\x03" else "say"
    inside = speaker in members
    if event == "say" and not inside:
        event = "join"
        members[speaker] = row["us"]
        state["count"] += 1
    receivers = state["count"]
    if event in ("quit", "close") and inside:
        members.pop(speaker)
        state["count"] -= 1
    return [{"us": row["us"], "speaker": speaker, "event": event, "receivers": receivers}]


def chat(stream: DataFrame, patience_us: int | None = None) -> DataFrame:
    """Events of chat rooms, a state entry for each member.

    With ``patience_us`` a room in which nobody speaks for so long is forgotten with its members.
    """
    return stream_fold(
        stream, ["channel"], ["us", "speaker"], chat_begin, chat_step,
        "channel bigint, us bigint, speaker string, event string, receivers bigint",
        "count bigint", {"members": ("speaker string", "since bigint")},
        finish=_forget, patience_us=patience_us,
    )


# directory --------------------------------------------------------------------------------
def present_begin() -> dict:
    return {"inside": False}


def present_step(state: dict, row: dict) -> list[dict]:
    inside = state["inside"]
    if row["action"] in ("PING", "QUIT"):
        state["inside"] = row["action"] == "PING"
    return [{"resource": row["resource"], "us": row["us"], "event_id": row["event_id"],
             "action": row["action"], "inside": inside}]


def present(requests: DataFrame) -> DataFrame:
    """First half of the directory: whether the client is registered at each request."""
    return stream_fold(
        requests, ["client"], ORDER, present_begin, present_step,
        "client bigint, resource int, us bigint, event_id bigint, action string, inside boolean",
        "inside boolean",
    )


def owner_begin() -> dict:
    return {"owner": None}


def owner_step(state: dict, row: dict) -> list[dict]:
    action, reply, owner = row["action"], None, None
    if action == "PING":
        reply = 200
    elif row["inside"]:
        reply = 200
        if action == "COMMIT" and state["owner"] is None:
            state["owner"] = row["client"]
        elif action in ("QUERY", "TRANSFER"):
            owner = state["owner"]
            reply = 404 if owner is None else 200
    return [{"client": row["client"], "us": row["us"], "event_id": row["event_id"],
             "action": action, "reply": reply, "owner": owner}]


def replies(known: DataFrame) -> DataFrame:
    """Second half: the reply to each request from the owner of its resource.

    Takes the output of ``present``, as a stream of its own or in the same query.
    """
    return stream_fold(
        known, ["resource"], ORDER, owner_begin, owner_step,
        "resource int, client bigint, us bigint, event_id bigint, action string, reply int, "
        "owner bigint", "owner bigint",
    )


# packets ------------------------------------------------------------------------------------
def connections(trace: DataFrame) -> DataFrame:
    return stream_fold(
        trace, ["stream"], ORDER, packets.connection_begin, packets.connection_step,
        "stream bigint, us bigint, event_id bigint, kind string, seq int, state string, "
        "delivered boolean", "state string, expected bigint",
    )


def playout_begin() -> dict:
    return packets.playout_begin() | {"seq": None, "useq": None}


def _unwrapped(state: dict, seq: int) -> int:
    ahead = seq if state["seq"] is None else (seq - state["seq"]) % 65536
    if state["seq"] is not None and ahead > 32768:
        ahead -= 65536
    state["useq"] = (state["useq"] or 0) + ahead
    state["seq"] = seq
    return state["useq"]


def playout_step(state: dict, row: dict) -> list[dict]:
    return packets.playout_step(
        state, row | {"useq": _unwrapped(state, row["seq"]), "played": None}
    )


#: How long nothing of a key arrives until what is held back for more rows of it comes out.
PATIENCE_US = 600_000_000


def playout(df: DataFrame, depth_us: int, payload_us: int, max_us: int | None = None,
            patience_us: int = PATIENCE_US) -> DataFrame:
    """Fate of each packet once decided, by the times of its own stream.

    The packets of a stream behind others by any time get the fate they have in the batch form.
    What is buffered is played once nothing of a stream has arrived for ``patience_us``; packets
    that come after that, and belong before it, are late. Every packet has a row in the end.
    """
    limit = max_us if max_us is not None else 2 * depth_us
    settings = {
        "depth_us": F.lit(depth_us).cast("bigint"),
        "payload_us": F.lit(payload_us).cast("bigint"),
        "max_us": F.lit(limit).cast("bigint"),
    }

    def drain(state):
        rows = packets.playout_finish(state | {"depth": depth_us})
        top = [r["useq"] for r in rows] + ([] if state["played"] is None else [state["played"]])
        return rows, state | {"buffer": [], "played": max(top, default=None), "buffering": True}

    return stream_fold(
        df.withColumns(settings), ["stream"], ORDER, playout_begin, playout_step,
        "stream bigint, useq bigint, us bigint, event_id bigint, status string, out_us bigint",
        "buffer array<struct<useq:bigint,us:bigint,event_id:bigint>>, played bigint, "
        "buffering boolean, seq bigint, useq bigint",
        finish=drain, patience_us=patience_us,
    )


def late_begin() -> dict:
    return {"seq": None, "useq": None, "waiting": [], "position": None}


def late_step(state: dict, row: dict) -> list[dict]:
    """Too late: below a number whose packet arrived at least ``depth_us`` ago."""
    useq, waiting = _unwrapped(state, row["seq"]), state["waiting"]
    while waiting and waiting[0][0] <= row["us"]:
        played = waiting.pop(0)[1]
        state["position"] = played if state["position"] is None else max(played, state["position"])
    bisect.insort(waiting, (row["us"] + row["depth_us"], useq))
    late = state["position"] is not None and useq < state["position"]
    return [{"us": row["us"], "event_id": row["event_id"], "useq": useq, "too_late": late}]


def late(df: DataFrame, depth_us: int, name: str = "late") -> DataFrame:
    """Late flags, with the totals as metric ``name`` of each micro-batch's progress."""
    flagged = stream_fold(
        df.withColumn("depth_us", F.lit(depth_us).cast("bigint")), ["stream"], ORDER,
        late_begin, late_step,
        "stream bigint, us bigint, event_id bigint, useq bigint, too_late boolean",
        "seq bigint, useq bigint, waiting array<struct<due:bigint,useq:bigint>>, position bigint",
    )
    return flagged.observe(
        name, F.count(F.lit(1)).alias("packets"), F.count_if("too_late").alias("too_late")
    )


def mix_begin() -> dict:
    return {"period": None, "rounds": {}, "heard": {}}


def mix_step(state: dict, row: dict) -> list[dict]:
    """Sum each speaker's n-th packet of a period; rounds come out when the period is over."""
    out, period = [], row["us"] // row["period_us"]
    if state["period"] is not None and period > state["period"]:
        out += mixed(state)
        state["rounds"].clear()
        state["heard"].clear()
    state["period"] = period if state["period"] is None else max(period, state["period"])
    turn = state["heard"].get(row["speaker"], 0) + 1
    state["heard"][row["speaker"]] = turn
    speakers, pcm = state["rounds"].get(turn, (0, []))
    both = zip_longest(pcm, [] if row["pcm"] is None else row["pcm"], fillvalue=0)
    state["rounds"][turn] = (speakers + 1, [a + int(b) for a, b in both])
    return out


def mixed(state: dict) -> list[dict]:
    """The rounds of the period at hand."""
    return [
        {"period": state["period"], "round": turn, "speakers": speakers,
         "pcm": [max(-32768, min(32767, x)) for x in pcm]}
        for turn, (speakers, pcm) in sorted(state["rounds"].items())
    ]


def mix_rounds(df: DataFrame, period_us: int = 300_000, patience_us: int = PATIENCE_US) -> DataFrame:
    """Rounds of a channel's period once its next begins, or nothing arrives for ``patience_us``.

    A channel goes by its own packets, however far it is behind others. A packet that comes when
    its period is over is mixed into the one at hand, as in order of arrival it belongs there.
    """
    return stream_fold(
        df.withColumn("period_us", F.lit(period_us).cast("bigint")), ["channel"], ORDER,
        mix_begin, mix_step,
        "channel bigint, period bigint, round bigint, speakers bigint, pcm array<bigint>",
        "period bigint",
        {"rounds": ("round bigint", "speakers bigint, pcm array<bigint>"),
         "heard": (f"speaker {dict(df.dtypes)['speaker']}", "turn bigint")},
        finish=lambda state: (mixed(state), None), patience_us=patience_us,
    )


# queues and limits ------------------------------------------------------------------------
def backlog(rows: DataFrame, capacity: int = queues.CAPACITY) -> DataFrame:
    return stream_fold(
        rows.withColumn("capacity", F.lit(capacity)), ["viewer"], ORDER,
        queues.queue_begin, queues.queue_step,
        "viewer bigint, event_id bigint, dropped_by bigint",
        "queue array<struct<event_id:bigint,is_key:boolean>>",
    )


def rate_limit(df: DataFrame, interval_us: int, burst: int) -> DataFrame:
    settings = {"interval": F.lit(interval_us).cast("bigint"), "burst": F.lit(burst)}
    return stream_fold(
        df.withColumns(settings), ["source"], ORDER, limits.limit_begin, limits.limit_step,
        "source bigint, us bigint, event_id bigint, window_us bigint, passed boolean",
        "since bigint, passed bigint",
    )


# idle keys ------------------------------------------------------------------------------
def idle_begin() -> dict:
    return {"from": None, "last": None, "rows": 0}


def idle_step(state: dict, row: dict) -> list[dict]:
    """Ends the span before once a row comes after the gap."""
    out = []
    if state["last"] is not None and row["us"] - state["last"] >= row["gap_us"]:
        out = idle_span(state, row["gap_us"])
        state.update(idle_begin())
    if state["from"] is None:
        state["from"] = row["us"]
    state.update(last=row["us"], rows=state["rows"] + 1)
    return out


def idle_span(state: dict, gap_us: int) -> list[dict]:
    return [{"from_us": state["from"], "last_us": state["last"], "rows": state["rows"],
             "suspend_us": state["last"] + gap_us}]


def idle(stream: DataFrame, key: str, gap_us: int, patience_us: int | None = None) -> DataFrame:
    """An alert for each active span of a ``key`` (bigint): its rows are less than ``gap_us`` apart.

    A span ends with the key's next row after a gap, or once nothing of it has arrived for
    ``patience_us`` (by default ``gap_us``), without waiting for another row; the key's state is
    dropped then, and a row after it opens a new span.
    """
    return stream_fold(
        stream.withColumn("gap_us", F.lit(gap_us).cast("bigint")), [key], ORDER,
        idle_begin, idle_step,
        f"{key} bigint, from_us bigint, last_us bigint, rows bigint, suspend_us bigint",
        "from bigint, last bigint, rows bigint",
        finish=lambda state: (idle_span(state, gap_us), None),
        patience_us=gap_us if patience_us is None else patience_us,
    )


# windows ------------------------------------------------------------------------------------
def sessions(df: DataFrame, key: str, gap: str | Column, delay: str, ts: str = "ts") -> DataFrame:
    """Active spans per key, out once the watermark passes their end; gap may vary by row."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap), key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            key, F.col("session_window.start").alias("from_ts"),
            F.col("session_window.end").alias("suspend_ts"), "rows",
        )
    )


def segments(frames: DataFrame, delay: str, seconds: int = playlist.SEGMENT_SECONDS,
             ts: str = "ts") -> DataFrame:
    """Frames and bytes per channel and aligned segment, out once the watermark passes it."""
    return (
        frames.withWatermark(ts, delay)
        .groupBy("channel", F.window(ts, f"{seconds} seconds"))
        .agg(F.count(F.lit(1)).alias("frames"), F.sum("size").alias("bytes"))
        .select("channel", F.col("window.start").alias("from_ts"), "frames", "bytes")
    )


def anchored_segments(frames: DataFrame, seconds: int = playlist.SEGMENT_SECONDS) -> DataFrame:
    length = F.lit(seconds * 1_000_000).cast("bigint")
    return stream_fold(
        frames.withColumn("length", length), ["channel"], ORDER,
        playlist.segment_begin, playlist.segment_step,
        "channel bigint, us bigint, event_id bigint, cut boolean, since_us bigint",
        "since bigint",
    )
