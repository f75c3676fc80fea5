"""Channels, membership and chat over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from liveops.operators import channels, keyed, membership
from liveops.plans.fixtures import VIEWS
from liveops.plans.registry import query

VIEWS |= {
    "changes": (("signals",), """SELECT * FROM (SELECT *, lag(action) OVER (
        PARTITION BY channel, client ORDER BY us, event_id) AS was FROM signals)
        WHERE action <> coalesce(was, 'LEAVE')"""),
    "spans": (("changes",), """SELECT channel, client, us AS from_us, next_us AS to_us,
        event_id AS from_id, next_id AS to_id FROM (SELECT *,
        lead(us) OVER w AS next_us, lead(event_id) OVER w AS next_id FROM changes
        WINDOW w AS (PARTITION BY channel, client ORDER BY us, event_id)) WHERE action = 'JOIN'"""),
    "steps": (("spans",), """SELECT channel, from_us AS us, from_id AS event_id,
        CAST(1 AS BIGINT) AS step FROM spans
        UNION ALL SELECT channel, to_us, to_id, CAST(-1 AS BIGINT) FROM spans
        WHERE to_us IS NOT NULL"""),
    "running": (("steps",), """SELECT *, CAST(sum(step) OVER (PARTITION BY channel
        ORDER BY us, event_id, step) AS BIGINT) AS members FROM steps"""),
    "counts": (("spans", "channel_list"), """SELECT channel, kind, CAST(CASE WHEN kind = 'camera'
        THEN n ELSE n // 2 END AS BIGINT) AS viewers FROM (SELECT c.channel, c.kind,
        count(s.client) AS n FROM channel_list c LEFT JOIN spans s ON s.channel = c.channel
        AND s.to_us IS NULL GROUP BY ALL)"""),
    "status_signals": (("ticks",), """SELECT user_id AS channel,
        CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS signal,
        event_type = 'view' AS online, us, event_id FROM ticks
        WHERE event_type IN ('view', 'error') OR (event_type = 'purchase' AND k > 97)"""),
}


VIEWS |= {
    "room_signals": (("ticks",), """SELECT (user_id + k) % 8 AS channel, user_id AS client, us,
        event_id, CASE event_type WHEN 'signup' THEN 'JOIN' WHEN 'error' THEN 'LEAVE'
        WHEN 'view' THEN 'CREATE' WHEN 'purchase' THEN CASE WHEN k < 8 THEN 'CANCEL'
        ELSE 'JOIN' END END AS action FROM ticks
        WHERE event_type IN ('signup', 'error', 'view', 'purchase')"""),
    "lives": (("room_signals",), """SELECT channel, us AS from_us, event_id AS from_id, next_us AS to_us FROM (SELECT *,
        lead(us) OVER (PARTITION BY channel ORDER BY us, event_id) AS next_us FROM (SELECT *,
        lag(action) OVER (PARTITION BY channel ORDER BY us, event_id) AS was FROM room_signals
        WHERE action IN ('CREATE', 'CANCEL')) WHERE action <> coalesce(was, 'CANCEL'))
        WHERE action = 'CREATE'"""),
    "asked": (("room_signals", "lives"), """SELECT r.channel, r.client, r.us, r.event_id,
        CASE r.action WHEN 'CREATE' THEN 'JOIN' ELSE r.action END AS action,
        l.channel IS NOT NULL AS alive,
        coalesce(l.to_us, 9e18::BIGINT) AS until FROM room_signals r LEFT JOIN lives l
        ON l.channel = r.channel AND r.us >= l.from_us AND (l.to_us IS NULL OR r.us < l.to_us)
        WHERE r.action IN ('JOIN', 'LEAVE') OR (r.action = 'CREATE' AND r.event_id = l.from_id)"""),
    "joined": (("asked",), """SELECT * FROM (SELECT *, list_reduce(list({'act': action,
        'ch': channel, 'un': until, 'id': event_id, 'al': alive, 't': us}) OVER (
        PARTITION BY client ORDER BY us, event_id), lambda a, x: CASE
        WHEN x.act = 'JOIN' AND x.al AND NOT (a.ch >= 0 AND a.un > x.t) THEN {'act': 'in',
        'ch': x.ch, 'un': x.un, 'id': x.id, 'al': true, 't': x.t}
        WHEN NOT (a.ch >= 0 AND a.un > x.t) OR (x.act = 'LEAVE' AND a.ch = x.ch) THEN {'act': 'out',
        'ch': -1::BIGINT, 'un': 0::BIGINT, 'id': -1::BIGINT, 'al': false, 't': x.t} ELSE a END,
        {'act': 'out', 'ch': -1::BIGINT, 'un': 0::BIGINT, 'id': -1::BIGINT, 'al': false,
        't': 0::BIGINT}) AS m FROM asked) WHERE m.id = event_id"""),
}


def room_signals(t):
    kind = F.col("event_type")
    action = (
        F.when(kind == "signup", "JOIN").when(kind == "error", "LEAVE")
        .when(kind == "view", "CREATE").when(F.col("k") < 8, "CANCEL").otherwise("JOIN")
    )
    return t.ticks().where(kind.isin("signup", "error", "view", "purchase")).select(
        ((F.col("user_id") + F.col("k")) % 8).alias("channel"),
        F.col("user_id").alias("client"), "us", "event_id", action.alias("action"),
    )


def spans(t):
    return membership.intervals(t.signals())


def status_signals(t):
    kind = F.col("event_type")
    return t.ticks().where(
        kind.isin("view", "error") | ((kind == "purchase") & (F.col("k") > 97))
    ).select(
        F.col("user_id").alias("channel"),
        F.when(kind == "view", 0).when(kind == "error", 1).otherwise(2).alias("signal"),
        (kind == "view").alias("online"),
        "us",
        "event_id",
    )


@query("membership_intervals", "SELECT * FROM spans", "spans")
def membership_intervals(t):
    return spans(t)


@query("channel_viewers", "SELECT * FROM counts", "counts")
def channel_viewers(t):
    return channels.viewers(t.channel_list(), spans(t))


@query("channels_online", "SELECT CAST(sum(viewers) AS BIGINT) AS online FROM counts", "counts")
def channels_online(t):
    return channels.online(channels.viewers(t.channel_list(), spans(t)))


@query("membership_machine", """SELECT j.client, j.channel, j.us AS from_us, j.event_id AS from_id,
    CASE WHEN until = 9e18::BIGINT THEN l.us ELSE least(until, l.us) END AS to_us
    FROM joined j LEFT JOIN LATERAL (SELECT min(us) AS us FROM room_signals r
    WHERE r.client = j.client AND r.channel = j.channel AND r.action = 'LEAVE'
    AND (r.us, r.event_id) > (j.us, j.event_id)) l ON true""", "joined room_signals")
def membership_machine(t):
    return membership.machine(room_signals(t))


@query("channel_summary", """SELECT server, count(*) AS total,
    count(*) FILTER (kind = 'camera') AS cameras, count(*) FILTER (kind = 'relay') AS resources,
    string_agg(CAST(channel AS VARCHAR), ',' ORDER BY CAST(channel AS VARCHAR)) AS channel_set
    FROM channel_list GROUP BY server""", "channel_list")
def channel_summary(t):
    return channels.summary(t.channel_list())


@query("channel_concurrency", "SELECT * FROM running", "running")
def channel_concurrency(t):
    return channels.concurrency(spans(t))


@query("channel_peak", "SELECT channel, max(members) AS peak FROM running GROUP BY channel",
       "running")
def channel_peak(t):
    return channels.peak(spans(t))


@query("channel_admit", """SELECT channel, client, us, event_id, CASE WHEN row_number() OVER
    (PARTITION BY channel ORDER BY us, event_id) <= 6 THEN 200 ELSE 503 END AS http
    FROM signals WHERE action = 'JOIN'""", "signals")
def channel_admit(t):
    joins = t.signals().where(F.col("action") == "JOIN").drop("action")
    return channels.admit(joins, limit=5)


@query("channel_admit_live", """SELECT channel, client, us, event_id, m.http AS http FROM (
    SELECT *, list_reduce(list({'act': action, 'cl': client, 'ins': []::BIGINT[], 'http': 0})
    OVER (PARTITION BY channel ORDER BY us, event_id), lambda a, x: CASE WHEN x.act = 'LEAVE' THEN
    {'act': x.act, 'cl': x.cl, 'ins': list_filter(a.ins, lambda c: c <> x.cl), 'http': 0}
    WHEN list_contains(a.ins, x.cl) THEN {'act': x.act, 'cl': x.cl, 'ins': a.ins, 'http': 500}
    WHEN len(a.ins) >= 6 THEN {'act': x.act, 'cl': x.cl, 'ins': a.ins, 'http': 503}
    ELSE {'act': x.act, 'cl': x.cl, 'ins': list_append(a.ins, x.cl), 'http': 200} END,
    {'act': '', 'cl': 0::BIGINT, 'ins': []::BIGINT[], 'http': 0}) AS m FROM signals)
    WHERE action = 'JOIN'""", "signals")
def channel_admit_live(t):
    return channels.admit_live(t.signals(), limit=5)


@query("channel_all", """SELECT channel, server, true AS is_camera FROM channel_list
    WHERE kind = 'camera' UNION ALL SELECT channel, server, false FROM channel_list
    WHERE kind = 'relay'""", "channel_list")
def channel_all(t):
    rows = t.channel_list()
    cameras = rows.where(F.col("kind") == "camera").drop("kind")
    return channels.all_channels(cameras, rows.where(F.col("kind") == "relay").drop("kind"))


@query("channel_assign", """SELECT channel, event_id, us, action, client,
    CAST((row_number() OVER (ORDER BY us, event_id) - 1) % 8 AS INTEGER) AS worker
    FROM signals""", "signals")
def channel_assign(t):
    return channels.assign(t.signals(), ["us", "event_id"], 8)


@query("channel_status", """SELECT channel, CASE WHEN bool_or(signal = 2) THEN 2
    WHEN arg_max(signal, (us, event_id)) = 0 THEN 1 ELSE 3 END AS status
    FROM status_signals GROUP BY channel""", "status_signals")
def channel_status(t):
    return channels.status(status_signals(t).drop("online"))


@query("channel_edges", """SELECT channel, online, us, event_id, lead(us) OVER w - us AS lasted_us
    FROM (SELECT *, lag(online) OVER (PARTITION BY channel ORDER BY us, event_id) AS was
    FROM status_signals) WHERE was IS DISTINCT FROM online
    WINDOW w AS (PARTITION BY channel ORDER BY us, event_id)""", "status_signals")
def channel_edges(t):
    return channels.edges(status_signals(t).drop("signal"))


@query("keyed_latest", """SELECT server, code, bytes, k, us, event_id FROM snapshots
    QUALIFY row_number() OVER (PARTITION BY server ORDER BY us DESC, event_id DESC) = 1""",
       "snapshots")
def keyed_latest(t):
    return keyed.latest(t.snapshots(), "server", ["us", "event_id"])


@query("keyed_first", """SELECT server, code, bytes, k, us, event_id FROM snapshots
    QUALIFY row_number() OVER (PARTITION BY server ORDER BY us, event_id) = 1""", "snapshots")
def keyed_first(t):
    return keyed.first(t.snapshots(), "server", ["us", "event_id"])
