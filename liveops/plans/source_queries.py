"""Logs, playlists and media bytes that Spark writes from the tables and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from liveops.operators import packets
from liveops.plans.fixtures import VIEWS
from liveops.plans.media_queries import ITEM_ROLL, rolled
from liveops.plans.registry import query
from liveops.sources import logs, media_files, playlists

VIEWS |= {
    "flv_rows": (("ticks",), """SELECT event_id // 8 AS file, row_number() OVER (
        PARTITION BY event_id // 8 ORDER BY event_id) - 1 AS pos,
        CAST([8, 9, 18][k % 3 + 1] AS INTEGER) AS type, user_id * 100 + k + 16777216 * (k % 2) AS ts,
        [175, 23, 39][user_id % 3 + 1] AS b0, k % 2 AS b1, k % 5 AS extra FROM ticks"""),
}


def hexed(value, digits: int):
    return F.lpad(F.hex(value), digits, "0")


def joined(rows, key, place, piece):
    """Bytes of each bounded group in order."""
    return rows.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(place, piece.alias("_h")))),
                        lambda e: e["_h"]), "",
        ).alias("_hex")
    )


@query("log_server_lines", """SELECT event_id, make_timestamp(us // 1000000 * 1000000) AS ts,
    event_type AS module, CASE WHEN k % 3 = 0 THEN '_ERROR_' ELSE '_INFO_' END AS level,
    CASE WHEN k % 6 = 0 THEN 'errno = ' || k || ' (broken)' ELSE 'value ' || user_id || ' : x' END
    AS msg, CASE WHEN k % 6 = 0 THEN k END AS errno FROM ticks""", "ticks")
def log_server_lines(t):
    level = F.when(F.col("k") % 3 == 0, "_ERROR_").otherwise("_INFO_")
    msg = F.when(
        F.col("k") % 6 == 0, F.concat(F.lit("errno = "), "k", F.lit(" (broken)"))
    ).otherwise(F.concat(F.lit("value "), "user_id", F.lit(" : x")))
    stamp = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss")
    line = F.concat(
        stamp, F.lit(" :  "), F.rpad("event_type", 15, " "), F.lit(" : "), F.rpad(level, 8, " "),
        F.lit(" : "), msg,
    )
    rows = logs.server_lines(t.ticks().select("event_id", line.alias("value")))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("log_at_most", """SELECT k % 5 AS level, count(*) AS n FROM ticks WHERE k % 5 <= 2
    GROUP BY 1""", "ticks")
def log_at_most(t):
    names = F.array(*[F.lit(x) for x in logs.STREAM_LEVELS])
    rows = t.ticks().select(
        (F.col("k") % 5).alias("rank"), F.element_at(names, F.col("k") % 5 + 1).alias("level")
    )
    kept = logs.at_most(rows, "_INFOV_").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    return kept.withColumnRenamed("rank", "level")


@query("log_access_lines", """SELECT page_id, make_timestamp(1700000000000000 + page_id * 1000000)
    AS time, page_id / 8 AS request_time, '10.0.0.' || (page_id % 250) AS addr, 200 AS status,
    page_id * 10 AS bytes, 'GET' AS method, url, '-' AS referer, 'agent x' AS agent, '' AS cookie,
    'b=' || page_id AS body, NULL::VARCHAR AS rejected FROM pages WHERE page_id % 7 <> 3 UNION ALL
    SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    'GET ' || url FROM pages WHERE page_id % 7 = 3""")
def log_access_lines(t):
    stamp = F.date_format(F.timestamp_seconds(F.col("page_id") + 1_700_000_000),
                          "dd/MMM/yyyy:HH:mm:ss Z")
    line = F.format_string(
        '[%s] %.3f 10.0.0.%d 200 %d GET %s  - "agent x" "" "b=%d"', stamp,
        F.col("page_id") / 8, F.col("page_id") % 250, F.col("page_id") * 10, F.col("url"),
        F.col("page_id"),
    )
    line = F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("GET "), "url")).otherwise(line)
    rows = logs.access_lines(t.pages.select("page_id", line.alias("value")))
    return rows.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("log_ini_settings", """SELECT CAST(p_partkey AS VARCHAR) AS file, section, key, value FROM (
    SELECT p_partkey, unnest(['server', 'server', 'media']) AS section,
    unnest(['name', 'size', 'name']) AS key,
    unnest([p_name, CAST(p_size AS VARCHAR), p_brand]) AS value FROM part)""")
def log_ini_settings(t):
    text = F.concat(
        F.lit("# made\n[server]\nname = "), "p_name", F.lit("\n\nsize="), "p_size",
        F.lit("\nname=again\n[media]\r\nname="), "p_brand", F.lit("\n"),
    )
    return logs.ini_settings(
        t.part.select(F.col("p_partkey").cast("string").alias("file"), text.alias("value"))
    )


@query("playlist_entries", f"""SELECT playlist, CAST(i - 1 AS BIGINT) AS pos, 15.0::DOUBLE AS duration,
    'http://cdn.test/' || urls[i] AS url, 15 AS target FROM (SELECT channel || '/' || seq
    AS playlist, urls FROM ({ITEM_ROLL})), range(1, 4) r(i) WHERE i <= len(urls)""", "items")
def playlist_entries(t):
    files = rolled(t).select(
        F.concat("channel", F.lit("/"), "seq").alias("playlist"), playlists.text().alias("value")
    )
    return playlists.entries(files, "cdn.test")


@query("media_flv_tags", """SELECT CAST(file AS VARCHAR) AS path, pos, type,
    CAST(2 + extra AS INTEGER) AS size, ts, CAST(CASE WHEN type = 9 THEN b0 // 16 END AS INTEGER)
    AS frame_type, CAST(CASE type WHEN 9 THEN b0 % 16 WHEN 8 THEN b0 // 16 END AS INTEGER) AS codec,
    CAST(CASE WHEN (type = 9 AND b0 % 16 = 7) OR (type = 8 AND b0 // 16 = 10) THEN b1 END AS INTEGER)
    AS packet_type FROM flv_rows""", "flv_rows")
def media_flv_tags(t):
    return media_files.flv_tags(flv_files(t, 8)).drop("offset", "stream_id", "data", "error")


def flv_files(t, tags: int):
    """(path, kind, content) of files of ``tags`` consecutive ticks."""
    ts = F.col("user_id") * 100 + F.col("k") + 16777216 * (F.col("k") % 2)
    kind = F.element_at(F.array(F.lit("08"), F.lit("09"), F.lit("12")), F.col("k") % 3 + 1)
    first = F.element_at(
        F.array(F.lit("AF"), F.lit("17"), F.lit("27")), (F.col("user_id") % 3 + 1).cast("int")
    )
    extra = F.col("k") % 5
    tag = F.concat(
        kind, hexed(2 + extra, 6), hexed(ts % 16777216, 6), hexed(F.floor(ts / 16777216), 2),
        F.lit("000000"), first, hexed(F.col("k") % 2, 2), F.repeat(F.lit("00"), extra),
        hexed(13 + extra, 8),
    )
    rows = t.ticks().select(F.expr(f"event_id div {tags}").alias("file"), "event_id", tag.alias("tag"))
    return joined(rows, "file", F.col("event_id"), F.col("tag")).select(
        F.col("file").cast("string").alias("path"), F.lit("flv").alias("kind"),
        F.unhex(F.concat(F.lit("464C5601050000000900000000"), "_hex")).alias("content"),
    )


@query("media_ts_packets", """SELECT CAST(event_id AS VARCHAR) AS path, CAST(0 AS BIGINT) AS pos,
    CAST(user_id % 8192 AS INTEGER) AS pid, 0 AS error_flag, CAST(k % 2 AS INTEGER) AS unit_start,
    0 AS priority, 0 AS scrambling, 1 AS adaptation, CAST(k % 16 AS INTEGER) AS cc,
    CASE WHEN k % 10 = 0 THEN 'no sync byte' END AS error FROM ticks""", "ticks")
def media_ts_packets(t):
    head = F.concat(
        F.when(F.col("k") % 10 == 0, "46").otherwise("47"),
        hexed((F.col("k") % 2) * 16384 + F.col("user_id") % 8192, 4),
        hexed(F.col("k") % 16 + 16, 2), F.repeat(F.lit("FF"), F.lit(184)),
    )
    files = t.ticks().select(
        F.col("event_id").cast("string").alias("path"), F.lit("ts").alias("kind"),
        F.unhex(head).alias("content"),
    )
    return media_files.ts_packets(files)


def _box(name: str, body, size: int):
    """A box around hex ``body`` of ``size`` bytes."""
    return F.concat(F.lit(f"{size + 8:08X}{name.encode().hex()}"), body)


@query("media_mp4_tracks", """SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(track AS INTEGER) AS track,
    CAST(CASE track WHEN 1 THEN 90000 ELSE 48000 END AS BIGINT) AS timescale,
    o_orderkey * track AS duration, 'eng' AS language,
    CASE track WHEN 1 THEN 'vide' ELSE 'soun' END AS handler FROM orders, range(1, 3) r(track)""")
def media_mp4_tracks(t):
    return media_files.mp4_tracks(media_files.mp4_boxes(mp4_files(t.orders, "o_orderkey", 5)))


def mp4_files(rows, key: str, body: int):
    """(path, kind, content) of a file of two tracks and ``body`` media bytes for each row."""

    def track(n, scale, handler):
        # Version 0 header: times, scale, duration, packed language "eng".
        mdhd = F.concat(
            F.lit("00" * 12), hexed(F.lit(scale), 8), hexed(F.col(key) * n, 8),
            F.lit("15C70000"),
        )
        hdlr = F.concat(F.lit("00" * 8), F.lit(handler.encode().hex()), F.lit("00" * 13))
        media = F.concat(_box("mdhd", mdhd, 24), _box("hdlr", hdlr, 25))
        return _box("trak", _box("mdia", media, 65), 73)

    content = F.concat(
        _box("mdat", F.lit("00" * body), body),
        _box("moov", F.concat(track(1, 90000, "vide"), track(2, 48000, "soun")), 162),
    )
    return rows.select(
        F.col(key).cast("string").alias("path"), F.lit("mp4").alias("kind"),
        F.unhex(content).alias("content"),
    )


@query("media_ws_frames", """SELECT CAST(doc_id AS VARCHAR) AS path, CAST(0 AS BIGINT) AS pos, true AS final,
    1 AS opcode, text FROM documents""")
def media_ws_frames(t):
    captures = t.documents.select(
        F.col("doc_id").cast("string").alias("path"),
        F.unhex(framed(F.col("text"), F.lit("00000000"))).alias("content"),
    )
    return media_files.ws_frames(captures).select("path", "pos", "final", "opcode", "text")


def framed(text, mask):
    """Hex of a text frame; ``mask`` is zero, so the body stands as it is."""
    size = F.octet_length(text)
    length = (
        F.when(size < 126, hexed(size + 128, 2))
        .when(size < 65536, F.concat(F.lit("FE"), hexed(size, 4)))
        .otherwise(F.concat(F.lit("FF"), hexed(size, 16)))
    )
    return F.concat(F.lit("81"), length, mask, F.hex(F.encode(text, "utf-8")))


@query("packet_rtmp", """SELECT event_id, CAST(k % 4 AS INTEGER) AS format,
    CAST(user_id % 64 AS INTEGER) AS chunk_stream, CAST([12, 8, 4, 1][k % 4 + 1] AS INTEGER)
    AS header_size, CASE WHEN k % 4 < 3 THEN event_id END AS timestamp,
    CASE WHEN k % 4 < 2 THEN CAST(k AS BIGINT) END AS size, CAST(CASE WHEN k % 4 < 2 THEN 20 END AS INTEGER)
    AS type, CASE WHEN k % 4 = 0 THEN user_id END AS stream_id FROM ticks""", "ticks")
def packet_rtmp(t):
    form = F.col("k") % 4
    data = F.concat(
        hexed(form * 64 + F.col("user_id") % 64, 2), hexed(F.col("event_id"), 6),
        hexed(F.col("k"), 6), F.lit("14"), hexed(F.col("user_id"), 8),
    )
    rows = t.ticks().select("event_id", F.unhex(data).alias("data"))
    return packets.rtmp(rows).drop("data")
