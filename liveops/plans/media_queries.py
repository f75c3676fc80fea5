"""Media, playlists, queues, limits, series and sample vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from liveops.functions import arrays, levels, maps
from liveops.functions.binary import crc32_mpeg, uint
from liveops.operators import limits, media, playlist, queues, series
from liveops.plans.channel_queries import spans
from liveops.plans.fixtures import HOUR, VIEWS
from liveops.plans.registry import query
from liveops.sources import playlists

DAY = 24 * HOUR
SERIES_ORDER = ["us", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]

VIEWS |= {
    "tag_bytes": (("ticks",), """SELECT event_id, CAST([8, 9, 18, 41][user_id % 4 + 1] AS INTEGER)
        AS type, [175, 23, 39, 18][k % 4 + 1] AS b0, k % 3 AS b1 FROM ticks"""),
    "ts_rows": (("ticks",), """SELECT user_id % 8 AS pid, k % 16 AS cc, us, event_id FROM ticks"""),
    "limited": (("ticks",), """SELECT user_id AS source, us, event_id, m.s AS window_us,
        m.ok AS passed FROM (SELECT user_id, us, event_id, list_reduce(
        list({'t': us, 's': -1::BIGINT, 'n': 0::BIGINT, 'ok': false}) OVER (PARTITION BY user_id
        ORDER BY us, event_id), lambda a, x: CASE
        WHEN a.s < 0 OR a.s + 86400000000 < x.t THEN {'t': x.t, 's': x.t, 'n': 1::BIGINT, 'ok': true}
        WHEN a.n <= 1 THEN {'t': x.t, 's': a.s, 'n': a.n + 1, 'ok': true}
        ELSE {'t': x.t, 's': a.s, 'n': a.n, 'ok': false} END,
        {'t': 0::BIGINT, 's': -1::BIGINT, 'n': 0::BIGINT, 'ok': false}) AS m FROM ticks)"""),
    "clock": (("ticks",), """SELECT user_id AS stream, us AS x,
        us + CAST(floor(value * 1000) AS BIGINT) AS y FROM ticks"""),
    "kept": (("clock",), """SELECT stream, x, y, list_filter(h, lambda s, i: s.x + 21600000000 >= x
        OR i - 1 >= len(h) - 1 - 4) AS h FROM (SELECT *, list({'x': x, 'y': y}) OVER (
        PARTITION BY stream ORDER BY x ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS h
        FROM clock)"""),
    "slopes": (("kept",), """SELECT stream, x, y, CASE WHEN len(h) < 4 THEN 1.0::DOUBLE ELSE
        list_reduce(list_transform(h, lambda s: CAST(s.x - ax AS DOUBLE) * CAST(s.y - ay AS DOUBLE)),
        lambda p, q: p + q) / list_reduce(list_transform(h, lambda s: CAST(s.x - ax AS DOUBLE)
        * CAST(s.x - ax AS DOUBLE)), lambda p, q: p + q) END AS slope FROM (SELECT *,
        CAST(list_sum(list_transform(h, lambda s: s.x)) // len(h) AS BIGINT) AS ax,
        CAST(list_sum(list_transform(h, lambda s: s.y)) // len(h) AS BIGINT) AS ay FROM kept)"""),
    "prefix": (("series",), """SELECT *, CAST(sum(v - 25) OVER (PARTITION BY key ORDER BY us,
        l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS BIGINT) AS p FROM series"""),
    "gains": (("levels",), """SELECT vec_id, v, list_transform(v, lambda x: abs(x)) AS a
        FROM levels"""),
    "cells": (("levels",), """SELECT vec_id AS frame, i - 1 AS bin, abs(v[i]) + 1 AS pa,
        abs(v[i]) + 1 + 3000 * (i % 5) AS pb FROM levels, range(1, 65) r(i)"""),
}


def tag_bytes(t):
    kinds = F.array(*[F.lit(x) for x in (8, 9, 18, 41)])
    first = F.array(*[F.lit(x) for x in ("AF", "17", "27", "12")])
    return t.ticks().select(
        "event_id",
        F.element_at(kinds, (F.col("user_id") % 4 + 1).cast("int")).alias("type"),
        F.unhex(
            F.concat(
                F.element_at(first, (F.col("k") % 4 + 1).cast("int")), F.lit("0"),
                (F.col("k") % 3).cast("string"),
            )
        ).alias("data"),
    )


@query("media_classify", """SELECT event_id, type, CASE type & 31 WHEN 8 THEN 'audio'
    WHEN 9 THEN 'video' WHEN 18 THEN 'script' END AS kind, (type & 31) = 9 AND b0 // 16 = 1 AS is_key,
    (type & 31) = 18 OR (ok AND b1 = 0) AS is_header, ok AS codec_ok FROM (SELECT *,
    CASE type & 31 WHEN 8 THEN b0 // 16 = 10 WHEN 9 THEN b0 % 16 = 7 ELSE (type & 31) = 18 END
    AS ok FROM tag_bytes)""", "tag_bytes")
def media_classify(t):
    return media.classify(tag_bytes(t)).drop("data")


@query("media_delivered", """SELECT s.channel, s.client, s.from_us, s.to_us, s.from_id,
    count(f.event_id) AS copies, CAST(coalesce(sum(f.size), 0) AS BIGINT) AS bytes
    FROM spans s LEFT JOIN frames f ON f.channel = s.channel AND NOT f.is_header
    AND f.us >= s.from_us AND (s.to_us IS NULL OR f.us < s.to_us) GROUP BY ALL""", "spans frames")
def media_delivered(t):
    return media.delivered(t.frames(), spans(t))


@query("media_headers_at_join", """SELECT s.channel, s.client, s.from_us AS us, s.from_id AS event_id,
    (SELECT max(f.event_id) FROM frames f WHERE f.channel = s.channel AND f.is_header
    AND f.track = 'audio' AND f.us <= s.from_us) AS audio_id,
    (SELECT max(f.event_id) FROM frames f WHERE f.channel = s.channel AND f.is_header
    AND f.track = 'video' AND f.us <= s.from_us) AS video_id FROM spans s""", "spans frames")
def media_headers_at_join(t):
    joins = spans(t).select(
        "channel", "client", F.col("from_us").alias("us"), F.col("from_id").alias("event_id")
    )
    headers = t.frames().where("is_header").withColumnRenamed("track", "kind")
    return media.headers_at_join(headers, joins, ["audio", "video"])


@query("media_interleave", """SELECT *, row_number() OVER (PARTITION BY channel
    ORDER BY pts, track DESC, event_id) AS place FROM (SELECT channel, track, us, event_id,
    (row_number() OVER (PARTITION BY channel, track ORDER BY us, event_id) - 1)
    * CASE track WHEN 'audio' THEN 2089 ELSE 3600 END AS pts FROM frames)""", "frames")
def media_interleave(t):
    rows = t.frames().select("channel", "track", "us", "event_id")
    return media.interleave(rows, 44100, 25)


@query("media_keyframe_cut", """SELECT * FROM (SELECT channel, us // 21600000000 AS segment,
    is_key, us, event_id FROM frames) f WHERE (us, event_id) >= (SELECT min((g.us, g.event_id))
    FROM frames g WHERE g.channel = f.channel AND g.is_key
    AND g.us // 21600000000 = f.segment)""", "frames")
def media_keyframe_cut(t):
    rows = playlist.segments(t.frames().select("channel", "is_key", "us", "event_id"), 6 * 3600)
    return media.keyframe_cut(rows)


@query("media_continuity", """SELECT pid, cc, us, event_id, coalesce((cc - lag(cc) OVER (
    PARTITION BY pid ORDER BY us, event_id) + 16) % 16 <> 1, false) AS broken FROM ts_rows""",
       "ts_rows")
def media_continuity(t):
    return media.continuity(ts_rows(t))


@query("media_refresh_gaps", """SELECT *, coalesce(gap_us <= 1200000000, true) AS in_time
    FROM (SELECT pid, cc, us, event_id, us - lag(us) OVER (PARTITION BY pid
    ORDER BY us, event_id) AS gap_us FROM ts_rows)""", "ts_rows")
def media_refresh_gaps(t):
    return media.refresh_gaps(ts_rows(t), 1_200_000_000)


def ts_rows(t):
    return t.ticks().select(
        (F.col("user_id") % 8).alias("pid"), (F.col("k") % 16).alias("cc"), "us", "event_id"
    )


# playlists -----------------------------------------------------------------------------
@query("playlist_segments", """SELECT channel, us // 15000000 AS segment, count(*) AS frames,
    CAST(sum(size) AS BIGINT) AS bytes FROM frames GROUP BY ALL""", "frames")
def playlist_segments(t):
    return playlist.segments(t.frames()).groupBy("channel", "segment").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("size").alias("bytes")
    )


@query("playlist_segments_anchored", """SELECT channel, us, event_id, m.s AS since_us,
    m.s = us AND m.c AS cut FROM (SELECT channel, us, event_id, list_reduce(list({'t': us,
    's': -1::BIGINT, 'c': false}) OVER (PARTITION BY channel ORDER BY us, event_id),
    lambda a, x: CASE WHEN a.s < 0 OR x.t - a.s >= 3600000000 THEN {'t': x.t, 's': x.t, 'c': true}
    ELSE {'t': x.t, 's': a.s, 'c': false} END, {'t': 0::BIGINT, 's': -1::BIGINT, 'c': false}) AS m
    FROM frames)""", "frames")
def playlist_segments_anchored(t):
    return playlist.anchored_segments(t.frames(), 3600)


ITEM_ROLL = """SELECT playlist AS channel, pos + 1 AS seq,
    list(url) OVER (PARTITION BY playlist ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
    AS urls, CASE WHEN pos + 1 > 3 THEN pos - 1 ELSE 1 END AS media_sequence FROM items"""


def rolled(t):
    return playlist.rolling(
        t.items().select(F.col("playlist").alias("channel"), (F.col("pos") + 1).alias("seq"), "url")
    )


@query("playlist_rolling", f"""SELECT channel, seq, array_to_string(urls, ' ') AS urls,
    media_sequence FROM ({ITEM_ROLL})""", "items")
def playlist_rolling(t):
    return rolled(t).withColumn("urls", F.array_join("urls", " "))


@query("playlist_text", f"""SELECT channel, seq, '#EXTM3U' || chr(10) || '#EXT-X-TARGETDURATION:15'
    || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || media_sequence
    || chr(10) || array_to_string(list_transform(urls, lambda u: '#EXTINF:15,' || chr(10) || u
    || chr(10)), '') AS text FROM ({ITEM_ROLL})""", "items")
def playlist_text(t):
    return rolled(t).select("channel", "seq", playlists.text().alias("text"))


@query("playlist_loop", """SELECT i.playlist, url, CAST(slot AS BIGINT) AS slot FROM items i JOIN
    (SELECT playlist, count(*) AS n FROM items GROUP BY 1) c ON c.playlist = i.playlist
    JOIN range(0, 4) r(slot) ON i.pos = (i.playlist % 11 + slot) % n""", "items")
def playlist_loop(t):
    rows = t.items()
    start = rows.select("playlist").distinct().withColumn("pos", F.col("playlist") % 11)
    return playlist.loop(rows, start)


@query("playlist_schedule", """SELECT playlist, pos // 3 AS chunk, count(*) AS entries,
    CAST(sum(CAST(floor(duration * 10) AS BIGINT) * 100000) - 6770000 AS BIGINT) AS wait_us,
    pos // 3 * 3 AS media_sequence FROM items GROUP BY playlist, pos // 3""", "items")
def playlist_schedule(t):
    return playlist.schedule(t.items())


# queues and limits -----------------------------------------------------------------------
@query("queue_backlog", """SELECT viewer, m.id AS event_id, event_id AS dropped_by FROM (
    SELECT viewer, event_id, list_reduce(list({'q': [{'id': event_id, 'key': is_key}],
    'id': served}) OVER (PARTITION BY viewer ORDER BY us, event_id), lambda a, x: CASE
    WHEN x.id IS NOT NULL THEN {'q': a.q[x.id + 1:], 'id': NULL}
    WHEN len(a.q) < 9 THEN {'q': a.q || x.q, 'id': NULL}
    WHEN len(list_filter(a.q, lambda e: NOT e.key)) > 0 THEN
    {'q': list_filter(a.q, lambda e: e.id <> list_filter(a.q, lambda f: NOT f.key)[1].id) || x.q,
    'id': list_filter(a.q, lambda e: NOT e.key)[1].id}
    ELSE {'q': a.q[2:] || x.q, 'id': a.q[1].id} END,
    {'q': []::STRUCT(id BIGINT, key BOOLEAN)[], 'id': NULL::BIGINT}) AS m FROM (
    SELECT user_id % 16 AS viewer, us, event_id, event_type = 'purchase' AS is_key,
    CASE WHEN event_type = 'view' THEN CAST(k % 6 AS BIGINT) END AS served FROM ticks))
    WHERE m.id IS NOT NULL""", "ticks")
def queue_backlog(t):
    kind = F.col("event_type")
    rows = t.ticks().select(
        (F.col("user_id") % 16).alias("viewer"), "us", "event_id",
        (kind == "purchase").alias("is_key"),
        F.when(kind == "view", (F.col("k") % 6).cast("int")).alias("served"),
    )
    return queues.backlog(rows, 9)


def limited(t):
    return limits.rate_limit(
        t.ticks().select(F.col("user_id").alias("source"), "us", "event_id"), DAY, 1
    )


@query("log_rate_limit", "SELECT * FROM limited", "limited")
def log_rate_limit(t):
    return limited(t)


@query("log_suppressed", """SELECT source, window_us, count(*) AS events,
    count(*) FILTER (NOT passed) AS suppressed FROM limited GROUP BY 1, 2""", "limited")
def log_suppressed(t):
    return limits.suppressed(limited(t))


# series ----------------------------------------------------------------------------------
@query("series_top_k", """SELECT key, v, l_orderkey, l_partkey, l_extendedprice FROM series
    ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, key, v LIMIT 50""", "series")
def series_top_k(t):
    rows = t.series().select("key", "v", "l_orderkey", "l_partkey", "l_extendedprice")
    return series.top_k(rows, "l_extendedprice", 50, ["l_orderkey", "l_partkey", "key", "v"])


@query("series_sorted", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice")
def series_sorted(t):
    return series.sort(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("series_sorted_text", "SELECT p_partkey, p_name FROM part ORDER BY p_name DESC")
def series_sorted_text(t):
    return series.sort(t.part.select("p_partkey", "p_name"), "p_name", ascending=False)


@query("series_kth_largest", """SELECT key, v FROM series QUALIFY row_number() OVER (PARTITION BY key
    ORDER BY v DESC, us, l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 5""", "series")
def series_kth_largest(t):
    return series.kth_largest(t.series(), 5, "key", "v", SERIES_ORDER)


@query("series_extremes", """SELECT key, min(v) AS least, max(v) AS greatest FROM series
    GROUP BY key""", "series")
def series_extremes(t):
    return series.extremes(t.series(), "key", "v")


@query("series_contains", """SELECT key, v, count(*) AS n FROM series
    WHERE v IN (SELECT p_size FROM part WHERE p_brand = 'Brand#2') GROUP BY 1, 2""", "series")
def series_contains(t):
    values = t.part.where(F.col("p_brand") == "Brand#2").select(
        F.col("p_size").cast("bigint").alias("v")
    )
    return series.contains(t.series().select("key", "v"), values, "v").groupBy("key", "v").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("series_run_sums", """SELECT key, greatest(0, max(p - least(0, lo))) AS max_run,
    min(p - greatest(0, hi)) AS min_run FROM (SELECT *, min(p) OVER w AS lo, max(p) OVER w AS hi
    FROM prefix WINDOW w AS (PARTITION BY key ORDER BY us, l_orderkey, l_linenumber, l_partkey,
    l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY key""", "prefix")
def series_run_sums(t):
    rows = t.series().withColumn("v", F.col("v") - 25)
    return series.run_sums(rows, "key", SERIES_ORDER, "v")


def clock(t):
    return t.ticks().select(
        F.col("user_id").alias("stream"), F.col("us").alias("x"),
        (F.col("us") + F.floor(F.col("value") * 1000)).alias("y"),
    )


@query("series_drift", "SELECT stream, x, y, round(slope, 6) AS slope FROM slopes", "slopes")
def series_drift(t):
    return series.drift(clock(t), "stream", 6 * HOUR, 4).withColumn("slope", F.round("slope", 6))


# One step of the smoothed clock: on the goal's line from the goal on, else the Hermite cubic.
_CUBIC = """list_transform([(s.x0 - a.x0) / (a.x1 - a.x0)::DOUBLE], lambda u: {})[1]"""
_VALUE = """CASE WHEN s.x0 >= a.x1 THEN greatest(0::BIGINT, a.y1
    + CAST(round_even(a.v1 * (s.x0 - a.x1), 0) AS BIGINT)) ELSE """ + _CUBIC.format("""greatest(
    0::BIGINT, a.y0 + CAST(round_even((a.y1 - a.y0) * u * u * (3 - 2 * u) + (a.x1 - a.x0) * u
    * (1 - u) * ((1 - u) * a.v0 - u * a.v1), 0) AS BIGINT))""") + " END"
_SLOPE = "CASE WHEN s.x0 >= a.x1 THEN a.v1 ELSE " + _CUBIC.format("""(a.y1 - a.y0)
    / (a.x1 - a.x0)::DOUBLE * 6 * u * (1 - u) + (a.v0 * (1 - u) * (1 - 3 * u)
    + a.v1 * u * (3 * u - 2))""") + " END"


def _smoothed(slope: str, sample_slope: str) -> str:
    return f"""SELECT stream, x, y, list_reduce(list({{'x0': x, 'y0': y, 'v0': {sample_slope},
    'x1': 0::BIGINT, 'y1': 0::BIGINT, 'v1': 0.0::DOUBLE}}) OVER (PARTITION BY stream ORDER BY x),
    lambda a, s: {{'x0': s.x0, 'y0': {_VALUE}, 'v0': {slope}, 'x1': s.x0 + 43200000000,
    'y1': s.y0 + CAST(round_even(s.v0 * 43200000000, 0) AS BIGINT), 'v1': s.v0}},
    {{'x0': 0::BIGINT, 'y0': 0::BIGINT, 'v0': 1.0::DOUBLE, 'x1': 0::BIGINT, 'y1': 0::BIGINT,
    'v1': 1.0::DOUBLE}}).y0 AS smooth FROM slopes"""


@query("series_smooth_time", _smoothed(_SLOPE, "slope"), "slopes")
def series_smooth_time(t):
    return series.smooth_time(clock(t), "stream", 6 * HOUR, 4, 12 * HOUR)


@query("series_smooth_time_monotonic", f"""SELECT stream, x, y, max(smooth) OVER (
    PARTITION BY stream ORDER BY x) AS smooth FROM ({_smoothed(
        f"greatest(0.0::DOUBLE, {_SLOPE})", "greatest(slope, 0.0::DOUBLE)")})""", "slopes")
def series_smooth_time_monotonic(t):
    return series.smooth_time(clock(t), "stream", 6 * HOUR, 4, 12 * HOUR, monotonic=True)


@query("series_unsmoothed_time", """SELECT stream, x, y, greatest(0::BIGINT, coalesce(
    lag(y) OVER w + CAST(round_even(lag(slope) OVER w * (x - lag(x) OVER w), 0) AS BIGINT), x))
    AS smooth FROM slopes WINDOW w AS (PARTITION BY stream ORDER BY x)""", "slopes")
def series_unsmoothed_time(t):
    return series.smooth_time(clock(t), "stream", 6 * HOUR, 4, 12 * HOUR, smoothing=False)


@query("series_spectral_score", """SELECT round(pow(e, 1 / 16.0), 6) AS error,
    round(100 * (1 - 0.5 * ln(1 + pow(e, 1 / 16.0)) / ln(1.13)), 6) AS score
    FROM (SELECT avg(pow(e, 4)) AS e FROM (SELECT frame, sum(e * e) / 21 AS e FROM (
    SELECT frame, band, sum(r - ln(r) - 1) / max(width) AS e FROM (SELECT frame,
    pb / pa::DOUBLE AS r, CASE WHEN bin < 16 THEN bin // 2 WHEN bin < 32 THEN 8 + (bin - 16) // 4
    WHEN bin < 56 THEN 12 + (bin - 32) // 8 ELSE 15 END AS band, CASE WHEN bin < 16 THEN 2
    WHEN bin < 32 THEN 4 WHEN bin < 56 THEN 8 ELSE 12 END AS width FROM cells) GROUP BY 1, 2)
    GROUP BY 1))""", "cells")
def series_spectral_score(t):
    cells = t.levels().select(F.col("vec_id").alias("frame"), F.posexplode("v").alias("bin", "p"))
    power = F.abs("p") + 1
    bend = power + 3000 * ((F.col("bin") + 1) % 5)
    out = series.spectral_score(
        cells.select("frame", "bin", power.cast("double").alias("power")),
        cells.select("frame", "bin", bend.cast("double").alias("power")),
    )
    return out.withColumns({"error": F.round("error", 6), "score": F.round("score", 6)})


# vectors ----------------------------------------------------------------------------------
def _text(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def vectors(t):
    return t.levels().select("vec_id", "v", F.transform("v", lambda x: F.abs(x)).alias("a"))


@query("vector_stats", """SELECT vec_id, CAST(list_sum(a) // 64 AS BIGINT) AS average,
    list_max(a) AS greatest, list_min(a) AS least FROM gains""", "gains")
def vector_stats(t):
    a = F.col("a")
    return vectors(t).select(
        "vec_id", arrays.average(a).alias("average"), F.array_max(a).alias("greatest"),
        F.array_min(a).alias("least"),
    )


@query("vector_merge", """SELECT vec_id, array_to_string(list_transform(list_zip(v, list_reverse(v)),
    lambda p: greatest(p[1], p[2])), ',') AS merged FROM gains""", "gains")
def vector_merge(t):
    v = F.col("v")
    return vectors(t).select("vec_id", _text(arrays.merge(v, F.reverse(v))).alias("merged"))


@query("vector_mix", """SELECT vec_id, array_to_string(list_transform(list_zip(v, list_reverse(v), a),
    lambda p: greatest(-32768, least(32767, 2 * p[1] + (p[2] * 32768 >> 16) + p[3]))), ',') AS mixed
    FROM gains""", "gains")
def vector_mix(t):
    v = F.col("v")
    weights = [F.lit(w).cast("bigint") for w in (131072, 32768, 65536)]
    mixed = arrays.mix([v, F.reverse(v), F.col("a")], weights)
    return vectors(t).select("vec_id", _text(mixed).alias("mixed"))


@query("vector_mix_pair", """SELECT vec_id, array_to_string(list_transform(list_zip(v, list_reverse(v)),
    lambda p: greatest(-32768, least(32767, CAST(trunc(p[1] + p[2] - (p[1] * p[2] / 32767.0::DOUBLE)
    * CASE WHEN p[1] < 0 AND p[2] < 0 THEN -1 ELSE 1 END) AS BIGINT)))), ',') AS mixed
    FROM gains""", "gains")
def vector_mix_pair(t):
    v = F.col("v")
    return vectors(t).select("vec_id", _text(arrays.mix_pair(v, F.reverse(v))).alias("mixed"))


@query("vector_channels", """SELECT vec_id, array_to_string(flatten(list_transform(
    list_zip(v, a), lambda p: [p[1], p[2]])), ',') AS woven,
    array_to_string(list_filter(v, lambda x, i: (i - 1) % 4 = 1), ',') AS second_of_four,
    array_to_string(flatten(list_transform(v, lambda x: [x, x])), ',') AS stereo,
    array_to_string(list_transform(range(1, 64, 2), lambda i: CAST(trunc((v[i] + v[i + 1]) / 2)
    AS BIGINT)), ',') AS mono FROM gains""", "gains")
def vector_channels(t):
    v = F.col("v")
    return vectors(t).select(
        "vec_id",
        _text(arrays.interleave([F.col("v"), F.col("a")])).alias("woven"),
        _text(arrays.deinterleave(v, 4, 1)).alias("second_of_four"),
        _text(arrays.to_stereo(v)).alias("stereo"),
        _text(arrays.to_mono(v)).alias("mono"),
    )


@query("vector_scale", """SELECT vec_id, array_to_string(list_transform(a, lambda x:
    CAST(x * 65536 // list_max(a) AS BIGINT)), ',') AS scaled FROM gains""", "gains")
def vector_scale(t):
    return vectors(t).select("vec_id", _text(arrays.scale(F.col("a"), levels.NORM)).alias("scaled"))


@query("vector_remap", """SELECT vec_id, array_to_string(list_transform(range(0, len(a) // 4),
    lambda i: a[4 * i + 1] || ',' || (a[4 * i + 2] + a[4 * i + 4]) // 2 || ',' || a[4 * i + 3] || ','
    || (a[4 * i + 1] + a[4 * i + 2] + a[4 * i + 3] + a[4 * i + 4]) // 4), ',') AS remapped
    FROM gains""", "gains")
def vector_remap(t):
    def four(i):
        return arrays.remap(
            F.slice("a", 4 * i + 1, 4), ["front-left", "front-right", "front-center", "rear-right"],
            ["front-left", "side-right", "mono", "lfe"],
        )

    frames = F.sequence(F.lit(0), F.floor(F.size("a") / 4).cast("int") - 1)
    out = F.flatten(F.transform(frames, four))
    return vectors(t).select("vec_id", _text(out).alias("remapped"))


@query("level_mapping", """SELECT o_orderkey, CAST(least(2147483647, round(cbrt(f) * 65536)) AS BIGINT)
    AS level, round(pow(round(cbrt(f) * 65536) / 65536, 3), 6) AS back,
    CAST((a * b + 32768) // 65536 AS BIGINT) AS product,
    CAST((a * 65536 + b // 2) // b AS BIGINT) AS quotient FROM (SELECT o_orderkey,
    o_totalprice / 100000 AS f, o_orderkey % 70000 AS a, o_custkey % 60000 + 1 AS b FROM orders)""")
def level_mapping(t):
    a, b = F.col("o_orderkey") % 70000, F.col("o_custkey") % 60000 + 1
    level = levels.from_linear(F.col("o_totalprice") / 100000)
    return t.orders.select(
        "o_orderkey", level.alias("level"), F.round(levels.to_linear(level), 6).alias("back"),
        levels.multiply(a, b).alias("product"), levels.divide(a, b).alias("quotient"),
    )


@query("integer_power", """SELECT p_partkey, CAST(round(pow(p_size, p_partkey % 5)) AS BIGINT)
    AS power FROM part""")
def integer_power(t):
    return t.part.select(
        "p_partkey", levels.power(F.col("p_size"), F.col("p_partkey") % 5).alias("power")
    )


@query("property_maps", """SELECT doc_id, lang || '|' || source AS merged,
    'de|' || source AS replaced, 'de|' AS taken, lang <> 'fr' AS has_lang, source AS unset_rest,
    lang = 'de' AS same FROM documents""")
def property_maps(t):
    old = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    new = F.create_map(F.lit("lang"), F.lit("de"))
    some = F.when(F.col("lang") == "fr", maps.unset(old, ["lang"])).otherwise(old)

    def shown(props):
        return F.concat_ws(
            "|", F.coalesce(maps.get(props, "lang"), F.lit("")),
            F.coalesce(maps.get(props, "source"), F.lit("")),
        )

    return t.documents.select(
        "doc_id",
        shown(maps.update(old, new, "merge")).alias("merged"),
        shown(maps.update(old, new, "replace")).alias("replaced"),
        shown(maps.update(old, new, "set")).alias("taken"),
        maps.contains(some, "lang").alias("has_lang"),
        F.array_join(F.map_values(maps.unset(old, ["lang"])), ",").alias("unset_rest"),
        maps.equal(maps.unset(old, ["source"]), new).alias("same"),
    )


@query("binary_reads", """SELECT event_id, b0 AS first, b0 * 256 + b1 AS both
    FROM tag_bytes""", "tag_bytes")
def binary_reads(t):
    return tag_bytes(t).select(
        "event_id", uint("data", 0, 1).cast("int").alias("first"),
        uint("data", 0, 2).cast("int").alias("both"),
    )


@query("binary_crc", """SELECT doc_id, list_reduce([4294967295::BIGINT] || list_transform(
    regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b * 16777216)] || range(8), lambda d, i:
    CASE WHEN d >= 2147483648 THEN xor((d * 2) & 4294967295, 79764919) ELSE d * 2 END)) AS crc
    FROM documents""")
def binary_crc(t):
    return t.documents.select(
        "doc_id", crc32_mpeg(F.encode("text", "utf-8"), 0xFFFFFFFF).alias("crc")
    )

