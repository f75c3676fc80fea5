"""Packet quality over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from liveops.operators import keyed, membership, packets
from liveops.operators.ordered import ordered, position
from liveops.plans.fixtures import HOUR, VIEWS
from liveops.plans.registry import query

VIEWS |= {
    "wrapped": (("packets",), """SELECT stream, CAST((row_number() OVER (PARTITION BY stream
        ORDER BY us, event_id) * 997) % 65536 AS INTEGER) AS seq, us, event_id FROM packets"""),
    "transit": (("packets",), """SELECT stream, us, event_id, coalesce(
        ((us - lag(us) OVER w) // 1000) * 0.00812347::DOUBLE - (rtp_ts - lag(rtp_ts) OVER w), 0.0)
        AS transit FROM packets WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)"""),
    "rfc_jitter": (("transit",), """SELECT *, max(jitter) OVER (PARTITION BY stream
        ORDER BY us, event_id) AS max_jitter FROM (SELECT stream, us, event_id, list_reduce(
        list(abs(transit)) OVER (PARTITION BY stream ORDER BY us, event_id),
        lambda j, d: j + (d - j) / 16, 0.0::DOUBLE) AS jitter FROM transit)"""),
    "seen": (("packets",), """SELECT *, coalesce(seq < max(seq) OVER (PARTITION BY stream
        ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
        AS out_of_order, coalesce(seq < max(seq) OVER (PARTITION BY stream ORDER BY us
        RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000 PRECEDING), false) AS too_late
        FROM packets"""),
    "rtt_samples": (("ticks",), """SELECT user_id AS stream, us, event_id,
        CASE WHEN event_type <> 'error' THEN value * 10.123456789::DOUBLE + 1 END AS rtt_ms
        FROM ticks"""),
    "rtp_words": (("ticks",), """SELECT event_id,
        (CASE WHEN event_id % 19 = 0 THEN 1 ELSE 2 END) * 1073741824::BIGINT
        + (k % 11) // 10 * 536870912::BIGINT + (k % 3) * 16777216::BIGINT
        + (k % 2) * 8388608::BIGINT + (k % 4) * 65536::BIGINT + k AS w0,
        CAST(floor(value * 8) AS BIGINT) AS w1, user_id AS w2, k FROM ticks"""),
    "speech": (("packets",), """SELECT stream % 16 AS channel, stream AS speaker,
        us, us // 60000000 AS spoken, event_id, seq, rtp_ts FROM packets"""),
    "trace": (("ticks",), """SELECT user_id AS stream, us, event_id, k % 3 AS seq,
        CASE WHEN event_type = 'signup' THEN 'SYN' WHEN event_type = 'error' THEN 'FIN'
        WHEN k % 10 < 2 THEN 'CONNECT' WHEN k % 10 = 2 THEN 'CLOSE' WHEN event_type = 'purchase'
        THEN 'ACK' ELSE 'DATA' END AS kind FROM ticks"""),
}
RATE = 0.00812347


def wrapped(t):
    rows = ordered(
        t.packets().select("stream", "us", "event_id"), ["stream"], ["us", "event_id"]
    ).running(n=position())
    return rows.map({"seq": (F.col("n") * 997 % 65536).cast("int")}).result("n")


def rtt_samples(t):
    return t.ticks().select(
        F.col("user_id").alias("stream"), "us", "event_id",
        F.when(F.col("event_type") != "error", F.col("value") * 10.123456789 + 1).alias("rtt_ms"),
    )


def rtp_words(t):
    k = F.col("k").cast("bigint")
    version = F.when(F.col("event_id") % 19 == 0, 1).otherwise(2).cast("bigint")
    w0 = (
        version * 2**30 + F.expr("(k % 11) div 10") * 2**29 + (k % 3) * 2**24
        + (k % 2) * 2**23 + (k % 4) * 2**16 + k
    )
    return t.ticks().select(
        "event_id", w0.alias("w0"), F.floor(F.col("value") * 8).alias("w1"),
        F.col("user_id").alias("w2"), "k",
    )


def datagrams(t):
    """Bytes of the header words and a body of k % 16 bytes that each hold 3."""

    def four(name):
        return F.lpad(F.hex(name), 8, "0")

    body = F.repeat(F.lit("03"), (F.col("k") % 16).cast("int"))
    return rtp_words(t).select(
        "event_id", F.unhex(F.concat(four("w0"), four("w1"), four("w2"), body)).alias("data")
    )


def speech(t):
    return t.packets().select(
        (F.col("stream") % 16).alias("channel"), F.col("stream").alias("speaker"), "us",
        F.expr("us div 60000000").alias("spoken"), "event_id", "seq", "rtp_ts",
    )


def trace(t):
    """Every kind of row, with few sequence numbers, so that all states are met."""
    event, part = F.col("event_type"), F.col("k") % 10
    kind = (
        F.when(event == "signup", "SYN").when(event == "error", "FIN").when(part < 2, "CONNECT")
        .when(part == 2, "CLOSE").when(event == "purchase", "ACK").otherwise("DATA")
    )
    return t.ticks().select(
        F.col("user_id").alias("stream"), "us", "event_id", (F.col("k") % 3).alias("seq"),
        kind.alias("kind"),
    )


FIELDS = """(w0 >> 30) & 3 AS version, (w0 >> 29) & 1 AS padding, (w0 >> 28) & 1 AS extension,
    (w0 >> 24) & 15 AS csrc_count, (w0 >> 23) & 1 AS marker, (w0 >> 16) & 127 AS payload_type,
    w0 & 65535 AS seq"""
HEADER_SQL = f"""SELECT event_id, CAST(version AS INT) AS version, CAST(padding AS INT) AS padding,
    CAST(extension AS INT) AS extension, CAST(csrc_count AS INT) AS csrc_count,
    CAST(marker AS INT) AS marker, CAST(payload_type AS INT) AS payload_type,
    CAST(seq AS INT) AS seq, w1 AS rtp_ts, w2 AS ssrc
    FROM (SELECT event_id, w1, w2, k, {FIELDS} FROM rtp_words)"""


@query("packet_header_words", HEADER_SQL, "rtp_words")
def packet_header_words(t):
    return packets.words(rtp_words(t).drop("k"))


@query("packet_valid_headers", HEADER_SQL + """ WHERE version = 2
    AND 12 + 4 * csrc_count + padding * (CASE WHEN k % 16 > 0 THEN 3 ELSE w2 % 256 END)
    <= 12 + k % 16""", "rtp_words")
def packet_valid_headers(t):
    return packets.rtp(packets.valid(datagrams(t))).drop("data")


@query("packet_pin_source", """SELECT * FROM packets p WHERE payload_type IN (0, 2) AND ssrc =
    (SELECT arg_min(ssrc, (us, event_id)) FROM packets q WHERE q.stream = p.stream
    AND payload_type IN (0, 2))""", "packets")
def packet_pin_source(t):
    return packets.pin_source(t.packets(), [0, 2])


@query("packet_authorised", """SELECT p.stream AS client, p.us, p.event_id, p.seq, s.channel,
    s.from_us, s.to_us FROM packets p JOIN spans s ON s.client = p.stream AND p.us >= s.from_us
    AND (s.to_us IS NULL OR p.us < s.to_us)""", "packets spans")
def packet_authorised(t):
    sent = t.packets().select(F.col("stream").alias("client"), "us", "event_id", "seq")
    return membership.authorised(sent, membership.intervals(t.signals()))


@query("packet_unauthorised", """SELECT p.stream AS client, count(*) AS rejected FROM packets p
    WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.client = p.stream AND p.us >= s.from_us
    AND (s.to_us IS NULL OR p.us < s.to_us)) GROUP BY 1""", "packets spans")
def packet_unauthorised(t):
    sent = t.packets().select(F.col("stream").alias("client"), "us", "event_id")
    known = membership.authorised(sent, membership.intervals(t.signals()), outer=True)
    return known.where(F.col("channel").isNull()).groupBy("client").agg(
        F.count(F.lit(1)).alias("rejected")
    )


@query("packet_unwrap", """SELECT stream, us, event_id, seq, CAST(row_number() OVER (
    PARTITION BY stream ORDER BY us, event_id) * 997 AS BIGINT) AS useq FROM wrapped""",
       "wrapped")
def packet_unwrap(t):
    return packets.unwrap(packets.arrivals(wrapped(t)), "seq", 16, "useq").result()


@query("packet_order", """SELECT stream, us, event_id, seq, CAST(seq AS BIGINT) AS useq,
    out_of_order FROM seen""", "seen")
def packet_order(t):
    return packets.order(t.packets().select("stream", "us", "event_id", "seq"))


@query("packet_late", "SELECT stream, us, event_id, seq, too_late FROM seen", "seen")
def packet_late(t):
    rows = t.packets().select("stream", "us", "event_id", "seq")
    return packets.late(rows, HOUR, "seq")


@query("packet_gaps", """SELECT * FROM (SELECT stream, lag(seq) OVER w AS after, seq AS before,
    CAST(seq - lag(seq) OVER w - 1 AS BIGINT) AS missing
    FROM (SELECT DISTINCT stream, seq FROM packets)
    WINDOW w AS (PARTITION BY stream ORDER BY seq)) WHERE missing > 0""", "packets")
def packet_gaps(t):
    return packets.gaps(t.packets())


@query("packet_missing", """SELECT stream, CAST(seq AS INT) AS seq FROM (SELECT stream,
    unnest(range(min(seq), max(seq))) AS seq FROM packets GROUP BY stream)
    EXCEPT SELECT stream, seq FROM packets""", "packets")
def packet_missing(t):
    return packets.missing(t.packets())


@query("packet_jitter", """SELECT stream, us, event_id, round(jitter, 3) AS jitter,
    round(max_jitter, 3) AS max_jitter FROM rfc_jitter""", "rfc_jitter")
def packet_jitter(t):
    rows = packets.jitter(
        packets.arrivals(t.packets().select("stream", "us", "event_id", "rtp_ts")), RATE
    )
    return rows.result("rtp_ts").withColumns(
        {"jitter": F.round("jitter", 3), "max_jitter": F.round("max_jitter", 3)}
    )


@query("packet_jitter_observed", """SELECT stream, us, event_id, round(list_reduce(list(d) OVER (
    PARTITION BY stream ORDER BY us, event_id), lambda j, d: j + (d - j) / 16, 0.0::DOUBLE), 3)
    AS jitter FROM (SELECT *, abs(transit - coalesce(lag(transit) OVER (PARTITION BY stream
    ORDER BY us, event_id), 0.0)) AS d FROM transit)""", "transit")
def packet_jitter_observed(t):
    rows = packets.jitter(
        packets.arrivals(t.packets().select("stream", "us", "event_id", "rtp_ts")), RATE,
        "observed",
    )
    return rows.result("rtp_ts", "max_jitter").withColumn("jitter", F.round("jitter", 3))


@query("packet_quality", """SELECT s.stream, count(*) AS packets,
    count(*) FILTER (out_of_order) AS out_of_order,
    CAST(max(seq) - min(seq) + 1 - count(DISTINCT seq) AS BIGINT) AS lost,
    count(*) FILTER (too_late) AS too_late,
    round(arg_max(jitter, (s.us, s.event_id)), 3) AS jitter, round(max(jitter), 3) AS max_jitter
    FROM seen s JOIN rfc_jitter j ON s.event_id = j.event_id GROUP BY s.stream""",
       "seen rfc_jitter")
def packet_quality(t):
    rows = packets.quality(
        t.packets().select("stream", "us", "event_id", "seq", "rtp_ts"), RATE, HOUR
    )
    return rows.withColumns(
        {"jitter": F.round("jitter", 3), "max_jitter": F.round("max_jitter", 3)}
    )


@query("packet_rtt", """SELECT stream, us, event_id, rtt_ms, round(m.s, 6) AS srtt,
    round(m.v, 6) AS rttvar, round(greatest(2.0::DOUBLE, least(60.0::DOUBLE, m.s + 4 * m.v))
    * pow(2, run), 5) AS rto, run > 3 AS gives_up
    FROM (SELECT *, lost - coalesce(max(CASE WHEN rtt_ms IS NOT NULL THEN lost END) OVER w, 0)
    AS run, list_reduce(coalesce(list({'s': 0.0::DOUBLE, 'v': 0.75::DOUBLE, 'r': rtt_ms / 1000.0})
    FILTER (rtt_ms IS NOT NULL) OVER w, []),
    lambda a, x: {'s': a.s + (x.r - a.s) / 8, 'v': a.v + (abs(x.r - a.s) - a.v) / 4, 'r': x.r},
    {'s': 0.0::DOUBLE, 'v': 0.75::DOUBLE, 'r': 0.0::DOUBLE}) AS m
    FROM (SELECT *, CAST(count(*) FILTER (rtt_ms IS NULL) OVER (PARTITION BY stream
    ORDER BY us, event_id) AS BIGINT) AS lost FROM rtt_samples)
    WINDOW w AS (PARTITION BY stream ORDER BY us, event_id))""", "rtt_samples")
def packet_rtt(t):
    return packets.rtt(rtt_samples(t)).withColumns(
        {"srtt": F.round("srtt", 6), "rttvar": F.round("rttvar", 6), "rto": F.round("rto", 5)}
    )


@query("packet_merge", """SELECT channel, speaker, us, spoken, event_id, seq, rtp_ts,
    row_number() OVER (PARTITION BY channel ORDER BY spoken,
    CASE WHEN r > 2 THEN -r ELSE r END, event_id) AS place
    FROM (SELECT *, dense_rank() OVER (PARTITION BY channel ORDER BY speaker) AS r
    FROM speech)""", "speech")
def packet_merge(t):
    return packets.merge(speech(t))


@query("packet_mix_rounds", """SELECT channel, period, round, count(*) AS speakers,
    CAST(greatest(least(sum(seq * 400), 32767), -32768) AS BIGINT) AS a,
    CAST(greatest(least(sum(-seq * 700), 32767), -32768) AS BIGINT) AS b,
    CAST(greatest(least(sum(rtp_ts), 32767), -32768) AS BIGINT) AS c
    FROM (SELECT channel, us // 21600000000 AS period, seq, rtp_ts, row_number() OVER (
    PARTITION BY channel, us // 21600000000, speaker ORDER BY us, event_id) AS round FROM speech)
    GROUP BY ALL""", "speech")
def packet_mix_rounds(t):
    pcm = F.array(
        (F.col("seq") * 400).cast("bigint"), (F.col("seq") * -700).cast("bigint"), F.col("rtp_ts")
    )
    rows = packets.mix_rounds(speech(t).withColumn("pcm", pcm), 6 * HOUR)
    return rows.select(
        "channel", "period", "round", "speakers",
        *[F.get("pcm", F.lit(i)).alias(n) for i, n in enumerate("abc")],
    )


@query("packet_alive", """SELECT stream, max(us) AS last_us FROM packets GROUP BY stream
    HAVING max(us) + 21600000000 >= (SELECT max(us) FROM packets)""", "packets")
def packet_alive(t):
    rows = t.packets()
    now = rows.agg(F.max("us")).scalar()
    return packets.alive(rows, now, 6 * HOUR)


@query("packet_sessions", """SELECT stream, span, min(us) AS from_us, max(us) AS last_us,
    count(*) AS rows, max(us) + 21600000000 AS suspend_us FROM (SELECT stream, us,
    CAST(sum(fresh) OVER (PARTITION BY stream ORDER BY us, event_id) AS BIGINT) AS span FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY stream ORDER BY us, event_id)
    < 21600000000 THEN 0 ELSE 1 END AS fresh FROM packets)) GROUP BY stream, span""", "packets")
def packet_sessions(t):
    return packets.expire(t.packets(), 6 * HOUR)


@query("keyed_idle", """SELECT user_id, span, min(us) AS from_us, max(us) AS last_us,
    count(*) AS rows, max(us) + max(gap) AS suspend_us FROM (SELECT user_id, us, gap,
    CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS span FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < gap
    THEN 0 ELSE 1 END AS fresh FROM (SELECT *, CASE WHEN user_id % 7 = 0 THEN 3600000000
    ELSE 21600000000 END AS gap FROM ticks))) GROUP BY user_id, span""", "ticks")
def keyed_idle(t):
    gap = F.when(F.col("user_id") % 7 == 0, HOUR).otherwise(6 * HOUR)
    return keyed.idle(t.ticks(), "user_id", F.timestamp_micros("us"), gap, "event_id")


_FOLDED = """, folded AS (SELECT stream, list_reduce(
    list({'buf': [{'u': seq::BIGINT, 't': us, 'id': event_id}], 'pl': -1::BIGINT, 'bf': true,
    'out': []::STRUCT(u BIGINT, t BIGINT, id BIGINT, st VARCHAR, o BIGINT)[]} ORDER BY us, event_id),
    lambda a, x: list_transform([list_transform([{'a': a, 'x': x.buf[1],
    'n': len(a.buf) - len(list_filter(a.buf, lambda e, i: len(list_filter(a.buf[1:i],
    lambda f: f.t + 3600000000 > x.buf[1].t)) > 0))}],
    lambda s: {'x': s.x, 'buf': s.a.buf[s.n + 1:], 'pl': CASE WHEN s.n > 0 THEN s.a.buf[s.n].u
    ELSE s.a.pl END, 'bf': len(s.a.buf) = s.n OR (s.n = 0 AND s.a.bf),
    'out': s.a.out || list_transform(s.a.buf[1:s.n], lambda e: {'u': e.u, 't': e.t, 'id': e.id,
    'st': 'played', 'o': e.t + 3600000000})})[1]],
    lambda s: CASE WHEN s.x.u <= s.pl THEN {'buf': s.buf, 'pl': s.pl, 'bf': s.bf,
    'out': s.out || [{'u': s.x.u, 't': s.x.t, 'id': s.x.id, 'st': 'late', 'o': s.x.t}]}
    WHEN s.bf AND len(s.buf) + 1 >= 4 THEN {'buf': list_sort(s.buf || [s.x])[2:],
    'pl': list_sort(s.buf || [s.x])[1].u, 'bf': false, 'out': s.out || list_transform(
    list_sort(s.buf || [s.x])[1:1], lambda e: {'u': e.u, 't': e.t, 'id': e.id, 'st': 'played',
    'o': s.x.t})}
    WHEN len(s.buf) > 8 THEN {'buf': list_sort(s.buf[2:] || [s.x]), 'pl': s.pl, 'bf': s.bf,
    'out': s.out || list_transform(s.buf[1:1], lambda e: {'u': e.u, 't': e.t, 'id': e.id,
    'st': 'overflow', 'o': s.x.t})}
    ELSE {'buf': list_sort(s.buf || [s.x]), 'pl': s.pl, 'bf': s.bf, 'out': s.out} END)[1],
    {'buf': []::STRUCT(u BIGINT, t BIGINT, id BIGINT)[], 'pl': -1::BIGINT, 'bf': true,
    'out': []::STRUCT(u BIGINT, t BIGINT, id BIGINT, st VARCHAR, o BIGINT)[]}) AS m
    FROM packets GROUP BY stream)"""
_FATES = """SELECT stream, r.u AS useq, r.t AS us, r.id AS event_id, r.st AS status, r.o AS out_us
    FROM (SELECT stream, unnest(m.out || list_transform(m.buf, lambda e: {'u': e.u, 't': e.t,
    'id': e.id, 'st': 'played', 'o': e.t + 3600000000})) AS r FROM folded)"""


@query("packet_playout", f"{_FOLDED} {_FATES}", "packets")
def packet_playout(t):
    return packets.playout(t.packets(), HOUR, HOUR // 4)


@query("packet_playout_report", f"""{_FOLDED}, fates AS ({_FATES})
    SELECT stream, count(*) FILTER (status = 'played') AS played,
    count(*) FILTER (status = 'late') AS late, count(*) FILTER (status = 'overflow') AS overflow,
    coalesce(max(useq) FILTER (status = 'played') - min(useq) FILTER (status = 'played') + 1
    - count(DISTINCT useq) FILTER (status = 'played'), 0) AS skipped,
    count(*) FILTER (gone <= us) AS emptied FROM (SELECT *, max(CASE WHEN status <> 'late'
    THEN out_us END) OVER (PARTITION BY stream ORDER BY us, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM fates) GROUP BY stream""",
       "packets")
def packet_playout_report(t):
    return packets.playout_report(t.packets(), HOUR, HOUR // 4)


@query("packet_connections", """SELECT stream, us, event_id, kind, seq, m.st AS state,
    m.dl AS delivered FROM (SELECT *, list_reduce(list({'st': kind, 'ex': seq::BIGINT, 'dl': false})
    OVER (PARTITION BY stream ORDER BY us, event_id), lambda a, x: CASE
    WHEN x.st = 'FIN' AND a.st IN ('SYN_SENT', 'ESTABLISHED')
    THEN {'st': 'LISTEN', 'ex': a.ex, 'dl': false}
    WHEN x.st = 'CONNECT' AND a.st = 'LISTEN' THEN {'st': 'SYN_SENT', 'ex': x.ex, 'dl': false}
    WHEN x.st = 'SYN' AND a.st = 'LISTEN' THEN {'st': 'ESTABLISHED', 'ex': x.ex + 1, 'dl': false}
    WHEN x.st = 'ACK' AND a.st = 'SYN_SENT' AND x.ex = a.ex + 1
    THEN {'st': 'ESTABLISHED', 'ex': x.ex, 'dl': false}
    WHEN x.st = 'CLOSE' AND a.st = 'ESTABLISHED'
    THEN {'st': 'CLOSE_WAIT', 'ex': x.ex, 'dl': false}
    WHEN x.st = 'DATA' AND a.st = 'ESTABLISHED' AND x.ex = a.ex
    THEN {'st': a.st, 'ex': a.ex + 1, 'dl': true}
    WHEN x.st = 'ACK' AND a.st = 'ESTABLISHED' AND x.ex > a.ex
    THEN {'st': a.st, 'ex': x.ex, 'dl': false}
    WHEN x.st = 'ACK' AND a.st = 'CLOSE_WAIT' AND x.ex = a.ex + 1
    THEN {'st': 'CLOSED', 'ex': a.ex, 'dl': false}
    ELSE {'st': a.st, 'ex': a.ex, 'dl': false} END,
    {'st': 'LISTEN', 'ex': 0::BIGINT, 'dl': false}) AS m FROM trace)""", "trace")
def packet_connections(t):
    return packets.connections(trace(t))


@query("packet_retransmits", """SELECT stream, seq, count(*) - 1 AS repeats,
    min(us) AS first_us, count(*) - 1 > 5 AS gives_up FROM trace WHERE kind = 'DATA'
    GROUP BY stream, seq""", "trace")
def packet_retransmits(t):
    return packets.retransmits(trace(t))

