"""Packet streams: headers, order, loss, jitter, round trips, play-out and mixing.

Columns: ``stream``, ``seq``, ``rtp_ts``, ``us`` (arrival, microseconds) and
``event_id`` (arrival order among equal times).
"""

from __future__ import annotations

import bisect
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveops.functions.arrays import saturate
from liveops.functions.binary import bits, uint
from liveops.operators import keyed
from liveops.operators.ordered import (
    Ordered, highest, latest, ordered, position, previous, smooth, total,
)
from liveops.operators.replay import Steps, composed, coupled

ARRIVAL = ["us", "event_id"]
RTP_VERSION = 2


# headers ---------------------------------------------------------------------
def words(df: DataFrame) -> DataFrame:
    """Header fields of the first three 32-bit words ``w0``, ``w1``, ``w2``."""
    return df.withColumns(
        {
            "version": bits("w0", 30, 2).cast("int"),
            "padding": bits("w0", 29, 1).cast("int"),
            "extension": bits("w0", 28, 1).cast("int"),
            "csrc_count": bits("w0", 24, 4).cast("int"),
            "marker": bits("w0", 23, 1).cast("int"),
            "payload_type": bits("w0", 16, 7).cast("int"),
            "seq": bits("w0", 0, 16).cast("int"),
            "rtp_ts": F.col("w1"),
            "ssrc": F.col("w2"),
        }
    ).drop("w0", "w1", "w2")


def rtp(df: DataFrame, data: str = "data") -> DataFrame:
    """Header fields of raw datagrams; nulls where the datagram is too short."""
    return words(
        df.withColumns({"w0": uint(data, 0, 4), "w1": uint(data, 4, 4), "w2": uint(data, 8, 4)})
    )


def is_valid(data: str = "data") -> Column:
    """At least 12 bytes, version 2, and CSRC list, extension and padding all fit."""

    def fits(d):
        first, body = d["first"], d["data"]
        after = F.lit(12) + 4 * bits(first, 0, 4)
        extension = F.when(
            bits(first, 4, 1) == 1, 4 + 4 * uint(body, (after + 2).cast("int"), 2)
        ).otherwise(0)
        padding = F.when(bits(first, 5, 1) == 1, uint(body, d["size"] - 1, 1)).otherwise(0)
        return F.coalesce(
            (d["size"] >= 12) & (bits(first, 6, 2) == RTP_VERSION)
            & (after + extension + padding <= d["size"]),
            F.lit(False),
        )

    # The one-element array holds what is read once and used several times.
    read = F.struct(
        F.length(data).alias("size"), uint(data, 0, 1).alias("first"), F.col(data).alias("data")
    )
    return F.exists(F.array(read), fits)


def valid(df: DataFrame, data: str = "data") -> DataFrame:
    return df.where(is_valid(data))


def rtmp(df: DataFrame, data: str = "data") -> DataFrame:
    """Chunk header at the start of each captured message."""
    first = uint(data, 0, 1)
    form = bits(first, 6, 2)
    return df.withColumns(
        {
            "format": form.cast("int"),
            "chunk_stream": bits(first, 0, 6).cast("int"),
            "header_size": F.element_at(
                F.array(*[F.lit(n) for n in (12, 8, 4, 1)]), form.cast("int") + 1
            ),
            "timestamp": F.when(form <= 2, uint(data, 1, 3)),
            "size": F.when(form <= 1, uint(data, 4, 3)),
            "type": F.when(form <= 1, uint(data, 7, 1)).cast("int"),
            "stream_id": F.when(form == 0, uint(data, 8, 4)),
        }
    )


# sources -----------------------------------------------------------------------
def pin_source(df: DataFrame, agreed: list[int]) -> DataFrame:
    """Packets of an agreed payload type from the first source id seen on their stream."""
    typed = df.where(F.col("payload_type").isin(agreed))
    pinned = keyed.first(
        typed.select("stream", "ssrc", *ARRIVAL), "stream", ARRIVAL
    ).select("stream", F.col("ssrc").alias("_pinned"))
    return typed.join(pinned, "stream").where(F.col("ssrc") == F.col("_pinned")).drop("_pinned")


def alive(df: DataFrame, now: int | Column, silence_us: int = 20_000_000) -> DataFrame:
    """Streams heard within the silence limit."""
    return df.groupBy("stream").agg(F.max("us").alias("last_us")).where(
        F.col("last_us") + silence_us >= now
    )


def expire(df: DataFrame, silence_us: int = 20_000_000) -> DataFrame:
    """Sessions per stream; one ends after the silence limit."""
    return keyed.idle(df, "stream", F.timestamp_micros("us"), F.lit(silence_us), "event_id")


# sequences -----------------------------------------------------------------------
def arrivals(df: DataFrame) -> Ordered:
    return ordered(df, ["stream"], ARRIVAL)


def unwrap(rows: Ordered, column: str, width: int, out: str) -> Ordered:
    """Undo wrap-around: each step is the nearest one modulo 2**width, halves going up."""
    modulus = 1 << width
    rows = rows.running(_prev=previous(column))
    ahead = F.pmod(F.col(column) - F.col("_prev"), F.lit(modulus))
    step = F.when(ahead <= modulus // 2, ahead).otherwise(ahead - modulus)
    rows = rows.map({"_step": F.coalesce(step, F.col(column)).cast("bigint")})
    rows = rows.running(**{out: total("_step")})
    return replace(rows, df=rows.df.drop("_prev", "_step"))


def order_flags(rows: Ordered, seq: str = "useq") -> Ordered:
    """Out of order: below a sequence number seen before."""
    rows = rows.running(_top=highest(seq, inclusive=False))
    rows = rows.map({"out_of_order": F.coalesce(F.col(seq) < F.col("_top"), F.lit(False))})
    return replace(rows, df=rows.df.drop("_top"))


def order(df: DataFrame) -> DataFrame:
    return order_flags(unwrap(arrivals(df), "seq", 16, "useq")).result()


def late(df: DataFrame, depth_us: int, seq: str = "useq") -> DataFrame:
    """Too late: below a sequence number already played, ``depth_us`` after it arrived."""
    played = df.select(
        "stream", (F.col("us") + depth_us).alias("us"), "event_id", F.lit(0).alias("_side"),
        F.col(seq).alias("_played"),
    )
    rest = [c for c in df.columns if c not in ("stream", "us", "event_id")]
    heard = df.select(
        "stream", "us", "event_id", F.lit(1).alias("_side"), F.struct(*rest).alias("_row")
    )
    rows = ordered(
        played.unionByName(heard, allowMissingColumns=True), ["stream"], ["us", "_side", "event_id"]
    ).running(_position=highest("_played"))
    return rows.df.where(F.col("_side") == 1).select(
        "stream", "us", "event_id", *[f"_row.{c}" for c in rest],
        F.coalesce(F.col(f"_row.{seq}") < F.col("_position"), F.lit(False)).alias("too_late"),
    )


def gaps(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Runs of missing sequence numbers per stream."""
    rows = ordered(df.select("stream", seq).distinct(), ["stream"], [seq])
    rows = rows.running(after=previous(seq))
    return rows.df.where(F.col(seq) - F.col("after") > 1).select(
        "stream", "after", F.col(seq).alias("before"),
        (F.col(seq) - F.col("after") - 1).cast("bigint").alias("missing"),
    )


def missing(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per missing sequence number."""
    return gaps(df, seq).select(
        "stream", F.explode(F.sequence(F.col("after") + 1, F.col("before") - 1)).alias(seq)
    )


def jitter(rows: Ordered, rate: float, mode: str = "rfc3550") -> Ordered:
    """Interarrival jitter (gain 1/16) and its maximum so far.

    ``rate`` is media units per millisecond. ``rfc3550`` takes the change in
    transit between neighbours; ``observed`` takes the change of that change,
    as results when the last media time stands in for the last arrival.
    """
    rows = rows.running(_us=previous("us"), _ts=previous("rtp_ts"))
    passed = F.expr("(us - _us) div 1000") * F.lit(rate)
    transit = F.coalesce(passed - (F.col("rtp_ts") - F.col("_ts")), F.lit(0.0))
    if mode == "observed":
        rows = rows.map({"_transit": transit}).running(_before=previous("_transit"))
        change = F.abs(F.col("_transit") - F.coalesce("_before", F.lit(0.0)))
    else:
        change = F.abs(transit)
    rows = smooth(rows.map({"_d": change}), "_d", 1 / 16, "jitter")
    rows = rows.running(max_jitter=highest("jitter"))
    return replace(rows, df=rows.df.drop("_us", "_ts", "_d", "_transit", "_before"))


def quality(df: DataFrame, rate: float, depth_us: int) -> DataFrame:
    """Per stream: packets, out of order, lost, too late, jitter and its maximum."""
    rows = jitter(order_flags(unwrap(arrivals(df), "seq", 16, "useq")), rate)
    flagged = late(rows.result(), depth_us)
    return flagged.groupBy("stream").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if("out_of_order").alias("out_of_order"),
        (F.max("useq") - F.min("useq") + 1 - F.count_distinct("useq")).alias("lost"),
        F.count_if("too_late").alias("too_late"),
        F.max_by("jitter", F.struct(*ARRIVAL)).alias("jitter"),
        F.max("jitter").alias("max_jitter"),
    )


# round trips ------------------------------------------------------------------------
RTO_MIN, RTO_MAX, MAX_RETRIES = 2.0, 60.0, 3
FIRST_VARIANCE = 0.75


def rtt(df: DataFrame) -> DataFrame:
    """Smoothed round trip (gain 1/8), deviation (1/4) and timeout per ``stream``.

    A row with null ``rtt_ms`` is a timeout: it doubles the timeout in force, and
    the sender gives up after more than three in a row.
    """
    rows = ordered(df, ["stream"], ARRIVAL)
    measured = replace(rows, df=rows.df.where(F.col("rtt_ms").isNotNull())).map(
        {"_rtt": F.col("rtt_ms") / 1000.0}
    )
    measured = smooth(measured, "_rtt", 1 / 8, "srtt").running(_srtt=previous("srtt"))
    measured = measured.map({"_off": F.abs(F.col("_rtt") - F.coalesce("_srtt", F.lit(0.0)))})
    measured = smooth(measured, "_off", 1 / 4, "rttvar", start=FIRST_VARIANCE)
    timeouts = rows.df.where(F.col("rtt_ms").isNull())
    both = measured.df.drop("_rtt", "_srtt", "_off").unionByName(
        timeouts, allowMissingColumns=True
    )
    known = F.when(F.col("rtt_ms").isNotNull(), F.struct("srtt", "rttvar"))
    lost = F.col("rtt_ms").isNull().cast("bigint")
    rows = replace(rows, df=both).running(_m=latest(known), _lost=total(lost))
    rows = rows.running(
        _lost_then=latest(F.when(F.col("rtt_ms").isNotNull(), F.col("_lost")))
    )
    in_a_row = F.col("_lost") - F.coalesce("_lost_then", F.lit(0).cast("bigint"))
    srtt = F.coalesce(F.col("_m.srtt"), F.lit(0.0))
    rttvar = F.coalesce(F.col("_m.rttvar"), F.lit(FIRST_VARIANCE))
    clamped = F.greatest(F.lit(RTO_MIN), F.least(F.lit(RTO_MAX), srtt + 4.0 * rttvar))
    return rows.result().select(
        "stream", *ARRIVAL, "rtt_ms", srtt.alias("srtt"), rttvar.alias("rttvar"),
        (clamped * F.pow(F.lit(2.0), in_a_row)).alias("rto"),
        (in_a_row > MAX_RETRIES).alias("gives_up"),
    )


# merging and mixing --------------------------------------------------------------------
def merge(df: DataFrame) -> DataFrame:
    """Packets of all speakers of a channel in speaking order, with their place.

    On equal times the first two speakers keep their order and each later
    speaker goes ahead of those before.
    """
    speakers = ordered(
        df.select("channel", "speaker").distinct(), ["channel"], ["speaker"]
    ).running(_rank=position()).result()
    ranked = df.join(speakers, ["channel", "speaker"]).withColumn(
        "_turn", F.when(F.col("_rank") > 2, -F.col("_rank")).otherwise(F.col("_rank"))
    )
    rows = ordered(ranked, ["channel"], ["spoken", "_turn", "event_id"])
    return rows.running(place=position()).result("_rank", "_turn")


def mix_rounds(df: DataFrame, period_us: int = 300_000) -> DataFrame:
    """Mix one packet per speaker and round; rounds restart in each period of a channel.

    Every value of ``pcm`` counts: a mix is as long as its longest packet, and a
    shorter one is silent after its end. Sums are taken per position, so speakers
    combine on the map side; a lone speaker passes through.
    """
    timed = df.withColumn("period", F.floor(F.col("us") / period_us))
    rows = ordered(timed, ["channel", "period", "speaker"], ARRIVAL).running(round=position())
    # Position -1 counts the packet itself, also an empty one.
    body = F.coalesce("pcm", F.array().cast("array<bigint>")).cast("array<bigint>")
    values = F.concat(F.array(F.lit(None).cast("bigint")), body)
    mixed = (
        rows.df.select("channel", "period", "round", F.posexplode(values).alias("_at", "_v"))
        .groupBy("channel", "period", "round", "_at")
        .agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("_v"), F.lit(0)).alias("_v"))
    )
    at = F.array_sort(F.collect_list(F.when(F.col("_at") > 0, F.struct("_at", "_v"))))
    return (
        mixed.groupBy("channel", "period", "round")
        .agg(F.max(F.when(F.col("_at") == 0, F.col("_n"))).alias("speakers"), at.alias("_pcm"))
        .select(
            "channel", "period", "round", "speakers",
            F.transform("_pcm", lambda v: saturate(v["_v"])).alias("pcm"),
        )
    )


# play-out buffer ------------------------------------------------------------------------
def playout_begin() -> dict:
    return {"buffer": None, "played": None, "buffering": True}


def _emit(entry, status, us) -> dict:
    return {"useq": entry[0], "us": entry[1], "event_id": entry[2], "status": status, "out_us": us}


def playout_step(state: dict, row: dict) -> list[dict]:
    """One arrival: play what is due, then reject, store or make room.

    A packet is due ``depth`` after arrival; a burst that fills the depth ends
    the buffering at once; beyond the maximum depth the front packet is dropped.
    """
    if state["buffer"] is None:
        state["buffer"], state["played"] = [], row["played"]
    buffer, out, now = state["buffer"], [], row["us"]
    depth, cap, unit = row["depth_us"], row["max_us"], row["payload_us"]

    def play(us):
        entry = buffer.pop(0)
        state["played"] = entry[0]
        out.append(_emit(entry, "played", us))

    while buffer and buffer[0][1] + depth <= now:
        play(buffer[0][1] + depth)
        state["buffering"] = False
    if not buffer:
        state["buffering"] = True
    entry = (row["useq"], row["us"], row["event_id"])
    if state["played"] is not None and entry[0] <= state["played"]:
        return out + [_emit(entry, "late", now)]
    if len(buffer) * unit > cap:
        out.append(_emit(buffer.pop(0), "overflow", now))
    bisect.insort(buffer, entry)
    if state["buffering"] and len(buffer) * unit >= depth:
        state["buffering"] = False
        play(now)
    return out


def playout_finish(state: dict) -> list[dict]:
    return [_emit(e, "played", e[1] + state["depth"]) for e in state["buffer"] or []]


def playout_freeze(state: dict):
    return [state["buffer"], state["played"], state["buffering"]]


def playout_thaw(frozen) -> dict:
    buffer, played, buffering = frozen
    return {"buffer": [tuple(entry) for entry in buffer], "played": played, "buffering": buffering}


def playout(df: DataFrame, depth_us: int, payload_us: int, max_us: int | None = None) -> DataFrame:
    """Fate of every packet in a play-out buffer: played, late or overflow.

    After a silence of ``depth_us`` the buffer has drained and the last packet
    played is the highest so far, so each stream is cut at such silences and the
    pieces run independently. A stream without silences is run in blocks, from an empty buffer
    and from the one the block before leaves, until both runs hold the same.
    """
    rows = unwrap(arrivals(df.select("stream", "seq", *ARRIVAL)), "seq", 16, "useq").running(
        _us=previous("us"), _top=highest("useq", inclusive=False)
    )
    fresh = (F.col("us") - F.col("_us") >= depth_us) | F.col("_us").isNull()
    rows = rows.map({"_fresh": fresh.cast("bigint")}).running(piece=total("_fresh"))
    settings = {
        "depth_us": F.lit(depth_us).cast("bigint"),
        "payload_us": F.lit(payload_us).cast("bigint"),
        "max_us": F.lit(max_us if max_us is not None else 2 * depth_us).cast("bigint"),
        "played": F.col("_top"),
    }

    machine = Steps(
        playout_begin, playout_step, playout_freeze, playout_thaw,
        finish=lambda state: playout_finish(state | {"depth": depth_us}),
    )
    return coupled(
        rows.map(settings).df.select(
            "stream", "piece", *ARRIVAL, "useq", "played", "depth_us", "payload_us", "max_us"
        ),
        ["stream", "piece"], ARRIVAL, machine,
        "stream bigint, useq bigint, us bigint, event_id bigint, status string, out_us bigint",
    )


def playout_report(df: DataFrame, depth_us: int, payload_us: int,
                   max_us: int | None = None) -> DataFrame:
    """Per stream what its play-out buffer did: played, late, overflow, skipped, emptied.

    skipped counts sequence numbers passed over on the way out, emptied how often the
    buffer had run out when the next packet was heard.
    """
    fates = playout(df, depth_us, payload_us, max_us)
    out = F.col("status") == "played"
    # A packet finds the buffer empty if all that came before has left.
    stored = F.col("status") != "late"
    rows = ordered(fates, ["stream"], ARRIVAL).running(
        _gone=highest(F.when(stored, F.col("out_us")), inclusive=False)
    )
    return rows.df.groupBy("stream").agg(
        F.count_if(out).alias("played"),
        F.count_if(F.col("status") == "late").alias("late"),
        F.count_if(F.col("status") == "overflow").alias("overflow"),
        F.coalesce(
            F.max(F.when(out, F.col("useq"))) - F.min(F.when(out, F.col("useq"))) + 1
            - F.count_distinct(F.when(out, F.col("useq"))), F.lit(0),
        ).cast("bigint").alias("skipped"),
        F.count_if(F.col("_gone") <= F.col("us")).alias("emptied"),
    )


# connections -------------------------------------------------------------------------------
WINDOW, MAX_RETRANSMITS, RETRANSMIT_US = 3, 5, 2_000_000


def connection_begin() -> dict:
    return {"state": "LISTEN", "expected": 0}


def connection_step(state: dict, row: dict) -> list[dict]:
    """One traced packet or local call (CONNECT, CLOSE); data count only in order."""
    kind, seq, delivered = row["kind"], row["seq"], False
    now = state["state"]
    if kind == "CONNECT" and now == "LISTEN":
        state.update(state="SYN_SENT", expected=seq)
    elif kind == "CLOSE" and now == "ESTABLISHED":
        state.update(state="CLOSE_WAIT", expected=seq)
    elif now == "LISTEN":
        if kind == "SYN":
            state.update(state="ESTABLISHED", expected=seq + 1)
    elif now == "SYN_SENT":
        if kind == "ACK" and seq == state["expected"] + 1:
            state.update(state="ESTABLISHED", expected=seq)
        elif kind == "FIN":
            state["state"] = "LISTEN"
    elif now == "ESTABLISHED":
        if kind == "DATA" and seq == state["expected"]:
            delivered = True
            state["expected"] = seq + 1
        elif kind == "ACK" and seq > state["expected"]:
            state["expected"] = seq
        elif kind == "FIN":
            state["state"] = "LISTEN"
    elif now == "CLOSE_WAIT" and kind == "ACK" and seq == state["expected"] + 1:
        state["state"] = "CLOSED"
    return [{
        "us": row["us"], "event_id": row["event_id"], "kind": kind, "seq": seq,
        "state": state["state"], "delivered": delivered,
    }]


class Connection:
    """The machine of a connection, whose expected number is unbounded."""

    #: Entry states with an expected number that matters; in the others it does not.
    counting = ("SYN_SENT", "ESTABLISHED", "CLOSE_WAIT")

    begin, step = staticmethod(connection_begin), staticmethod(connection_step)

    def finish(self, state):
        return []

    def freeze(self, state):
        return [state["state"], state["expected"] if state["state"] in self.counting else 0]

    def thaw(self, frozen):
        return dict(zip(("state", "expected"), frozen))

    def known(self):
        return [["LISTEN", 0], ["CLOSED", 0]]

    def before(self, opened, row):
        return []

    def after(self, opened, row):
        """Expected numbers that the row tells apart from others, with where it leads them.

        A row compares the expected number with its own, one less or one more, so numbers beyond
        those all go one way; two of them show whether that is to one state or to where they were.
        """
        seq = row["seq"] if row["seq"] is not None else 0
        out = []
        for name in self.counting:
            low = opened.setdefault(name, {"above": None, "done": set(), "all": False})
            if low["all"]:
                continue

            def led(expected, name=name):
                state = {"state": name, "expected": expected}
                connection_step(state, row)
                return self.freeze(state)

            ends = {x: led(x) for x in range(seq - 3, seq + 4)}
            under, over = (
                ends[a] if ends[a] == ends[b] else None for a, b in ((seq - 3, seq - 2), (seq + 2, seq + 3))
            )
            if under is not None and all(end == under for end in ends.values()):
                out.append(({"state": name, "low": None, "high": None}, under))
                low["all"] = True
                continue
            if over is not None:
                raise ValueError("rows must not tell large numbers from small ones only")
            if under is not None:
                high = max(x for x in ends if all(ends[y] == under for y in range(seq - 3, x + 1)))
                if low["above"] is None or high > low["above"]:
                    out.append(({"state": name, "low": None, "high": high}, under))
                    low["above"] = high
            for x in (seq - 1, seq, seq + 1):
                known = x in low["done"] or (low["above"] is not None and x <= low["above"])
                if not known and ends[x] != [name, x]:
                    out.append(({"state": name, "low": x, "high": x}, ends[x]))
                    low["done"].add(x)
        return out

    def matches(self, kind, frozen):
        return kind["state"] == frozen[0] and (
            kind["low"] is None or kind["low"] <= frozen[1]
        ) and (kind["high"] is None or frozen[1] <= kind["high"])


def connections(trace: DataFrame) -> DataFrame:
    """State after each row of a trace per ``stream`` and whether its data were delivered.

    A FIN leaves every state but those after a local CLOSE in LISTEN, so traces
    are cut after each FIN until a CLOSE is seen. Long pieces are shared by their maps of states.
    """
    closed = F.col("kind").isin("CLOSE").cast("bigint")
    rows = ordered(trace, ["stream"], ARRIVAL).running(_closed=total(closed))
    cut = ((F.col("kind") == "FIN") & (F.col("_closed") == 0)).cast("bigint")
    rows = rows.map({"_cut": cut}).running(piece=total("_cut", inclusive=False))
    rows = rows.map({"piece": F.coalesce("piece", F.lit(0).cast("bigint"))})
    return composed(
        rows.df.select("stream", "piece", *ARRIVAL, "kind", "seq"),
        ["stream", "piece"], ARRIVAL, Connection(),
        "stream bigint, us bigint, event_id bigint, kind string, seq int, state string, "
        "delivered boolean",
    )


def retransmits(trace: DataFrame) -> DataFrame:
    """Repeats of each data packet; a sender gives up after five."""
    return (
        trace.where(F.col("kind") == "DATA")
        .groupBy("stream", "seq")
        .agg((F.count(F.lit(1)) - 1).alias("repeats"), F.min("us").alias("first_us"))
        .withColumn("gives_up", F.col("repeats") > MAX_RETRANSMITS)
    )
