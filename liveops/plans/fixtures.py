"""Inputs of the registered queries, derived from the driver tables.

Each fixture exists twice, as DataFrame and as SQL text, and covers every row
of its table. Times are BIGINT microseconds in the column ``us``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR = 3_600_000_000


class Tables:
    """Driver tables of one folder and the fixtures built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._schemas: dict[str, T.StructType] = {}
        # Times without zone count as UTC, whatever session the caller brings.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        """The table; its schema is read from the files once."""
        path = f"{self.folder}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    # events -----------------------------------------------------------------
    def ticks(self) -> DataFrame:
        return self.events.select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        )

    def signals(self) -> DataFrame:
        return self.ticks().where(F.col("event_type").isin("signup", "error")).select(
            (F.col("user_id") % 16).alias("channel"),
            F.col("user_id").alias("client"),
            F.when(F.col("event_type") == "signup", "JOIN").otherwise("LEAVE").alias("action"),
            "us",
            "event_id",
        )

    def channel_list(self) -> DataFrame:
        return self.events.select((F.col("user_id") % 16).alias("channel")).distinct().select(
            "channel",
            F.when(F.col("channel") % 5 == 0, "relay").otherwise("camera").alias("kind"),
            (F.col("channel") % 4).alias("server"),
        )

    def packets(self) -> DataFrame:
        return self.ticks().where(F.col("event_type").isin("click", "view", "purchase")).select(
            F.col("user_id").alias("stream"),
            F.col("k").alias("seq"),
            F.floor(F.col("value") * 8).alias("rtp_ts"),
            (F.col("k") % 4).alias("payload_type"),
            (F.col("k") % 3).alias("ssrc"),
            "us",
            "event_id",
        )

    def frames(self) -> DataFrame:
        return self.ticks().select(
            (F.col("user_id") % 16).alias("channel"),
            (F.col("event_type") == "purchase").alias("is_key"),
            (F.col("event_type") == "signup").alias("is_header"),
            F.when(F.col("user_id") % 3 == 0, "audio").otherwise("video").alias("track"),
            F.floor("value").alias("size"),
            "us",
            "event_id",
        )

    def snapshots(self) -> DataFrame:
        return self.ticks().select(
            (F.col("user_id") % 100).alias("server"),
            F.when(F.col("event_type") == "error", 10004).alias("code"),
            F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100)).alias("bytes"),
            "k",
            "us",
            "event_id",
        )

    def raw_docs(self) -> DataFrame:
        """JSON text; each 13th row misses one field."""
        return self.ticks().select(
            "event_id",
            (F.col("user_id") % 100).alias("sender"),
            "us",
            F.when(
                F.col("event_id") % 13 == 0,
                F.concat(F.lit('{"uptime":'), "user_id", F.lit(',"room":"r'), "k", F.lit('"}')),
            )
            .otherwise(
                F.concat(
                    F.lit('{"areaID":'), "k", F.lit(',"uptime":'), "user_id",
                    F.lit(',"room":"r'), "k", F.lit('"}'),
                )
            )
            .alias("body"),
        )

    def chat(self) -> DataFrame:
        """Turns; some say quit, also twice in a row or at first, and some close the browser."""
        turn = F.col("turn")
        leaves = (turn % 8).isin(3, 5) | ((turn == 0) & (F.col("conv_id") % 4 == 0))
        said = F.when(leaves, "quit").when(turn % 8 == 6, "\x03").otherwise(F.col("text"))
        return self.conversations.select(
            F.col("conv_id").alias("channel"), turn.alias("us"),
            F.col("role").alias("speaker"), said.alias("text"),
        )

    # orders and lineitem ----------------------------------------------------
    def catalog(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("ID"),
            F.col("o_custkey").alias("uid"),
            F.expr("CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END").alias("status"),
            F.col("o_orderpriority").alias("category"),
            (F.col("o_orderkey") % 8).alias("department"),
            F.col("o_totalprice").alias("hot"),
            (F.col("o_orderkey") % 1000).alias("hits"),
            F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("create_time"),
        )

    def invitees(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("grpID"), F.col("l_suppkey").alias("memberID")
        ).distinct()

    def series(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_suppkey").alias("key"),
            F.col("l_quantity").cast("bigint").alias("v"),
            F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_extendedprice",
        )

    def items(self) -> DataFrame:
        """Playlist entries: one playlist per order, placed by the whole row."""
        from liveops.operators.ordered import ordered, position

        rows = self.lineitem.select(
            F.col("l_orderkey").alias("playlist"),
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
            (F.col("l_quantity") / 4).alias("duration"),
        )
        numbered = ordered(
            rows, ["playlist"],
            ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "duration"],
        ).running(pos=position())
        return numbered.result().select(
            "playlist",
            (F.col("pos") - 1).alias("pos"),
            "duration",
            F.concat(F.lit("seg"), "l_partkey", F.lit(".ts")).alias("url"),
        )

    def servers(self) -> DataFrame:
        nation = F.broadcast(self.nation)
        return (
            self.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("server"),
                F.col("s_name").alias("IP"),
                F.col("n_name").alias("ISP"),
                F.col("r_name").alias("region"),
                F.col("n_regionkey").alias("areaID"),
            )
        )

    def levels(self) -> DataFrame:
        return self.embeddings.select(
            "vec_id",
            "label",
            F.transform(
                "embedding", lambda x: F.round(x.cast("double") * 32767).cast("bigint")
            ).alias("v"),
        )

    def requests(self) -> DataFrame:
        """Request lines made of the page urls."""
        path = F.regexp_replace("url", r"^https?://[^/]*", "")
        method = F.expr(
            "CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'HEAD' END"
        )
        mark = F.when(F.col("url").contains("?"), F.lit("&channel=")).otherwise(
            F.lit("?channel=")
        )
        tail = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(
            F.concat(F.lit("c"), (F.col("page_id") % 50).cast("string"))
        )
        src = F.when(F.col("page_id") % 5 == 0, F.lit("&src=10.0.0.1:8080")).otherwise(F.lit(""))
        return self.pages.select(
            "page_id", "url",
            F.concat(method, F.lit(" "), path, mark, tail, src, F.lit(" HTTP/1.1")).alias("line"),
        )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": ((), """SELECT event_id, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, epoch_us(ts) AS us
        FROM events"""),
    "signals": (("ticks",), """SELECT user_id % 16 AS channel, user_id AS client,
        CASE event_type WHEN 'signup' THEN 'JOIN' ELSE 'LEAVE' END AS action, us, event_id
        FROM ticks WHERE event_type IN ('signup', 'error')"""),
    "channel_list": ((), """SELECT channel,
        CASE WHEN channel % 5 = 0 THEN 'relay' ELSE 'camera' END AS kind, channel % 4 AS server
        FROM (SELECT DISTINCT user_id % 16 AS channel FROM events)"""),
    "packets": (("ticks",), """SELECT user_id AS stream, k AS seq,
        CAST(floor(value * 8) AS BIGINT) AS rtp_ts, k % 4 AS payload_type, k % 3 AS ssrc,
        us, event_id
        FROM ticks WHERE event_type IN ('click', 'view', 'purchase')"""),
    "frames": (("ticks",), """SELECT user_id % 16 AS channel, event_type = 'purchase' AS is_key,
        event_type = 'signup' AS is_header,
        CASE WHEN user_id % 3 = 0 THEN 'audio' ELSE 'video' END AS track,
        CAST(floor(value) AS BIGINT) AS size, us, event_id FROM ticks"""),
    "snapshots": (("ticks",), """SELECT user_id % 100 AS server,
        CASE WHEN event_type = 'error' THEN 10004 END AS code,
        CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS BIGINT) END AS bytes,
        k, us, event_id FROM ticks"""),
    "raw_docs": (("ticks",), """SELECT event_id, user_id % 100 AS sender, us,
        CASE WHEN event_id % 13 = 0 THEN '{"uptime":' || user_id || ',"room":"r' || k || '"}'
        ELSE '{"areaID":' || k || ',"uptime":' || user_id || ',"room":"r' || k || '"}' END AS body
        FROM ticks"""),
    "chat": ((), """SELECT conv_id AS channel, turn AS us, role AS speaker, CASE
        WHEN turn % 8 IN (3, 5) OR (turn = 0 AND conv_id % 4 = 0) THEN 'quit'
        WHEN turn % 8 = 6 THEN chr(3) ELSE text END AS text FROM conversations"""),
    "catalog": ((), """SELECT o_orderkey AS ID, o_custkey AS uid,
        CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS status,
        o_orderpriority AS category, o_orderkey % 8 AS department, o_totalprice AS hot,
        o_orderkey % 1000 AS hits, epoch_us(o_orderdate) AS create_time FROM orders"""),
    "invitees": ((), """SELECT DISTINCT l_orderkey AS grpID, l_suppkey AS memberID
        FROM lineitem"""),
    "series": ((), """SELECT l_suppkey AS key, CAST(l_quantity AS BIGINT) AS v,
        epoch_us(l_shipdate) AS us, l_orderkey, l_linenumber, l_partkey, l_extendedprice
        FROM lineitem"""),
    "items": ((), """SELECT l_orderkey AS playlist, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos,
        l_quantity / 4 AS duration, 'seg' || l_partkey || '.ts' AS url FROM lineitem"""),
    "servers": ((), """SELECT s_suppkey AS server, s_name AS IP, n_name AS ISP, r_name AS region,
        n_regionkey AS areaID FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "levels": ((), """SELECT vec_id, label, list_transform(embedding,
        lambda x: CAST(round(CAST(x AS DOUBLE) * 32767) AS BIGINT)) AS v FROM embeddings"""),
    "requests": ((), r"""SELECT page_id, url,
        CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'HEAD' END || ' '
        || regexp_replace(url, '^https?://[^/]*', '')
        || CASE WHEN contains(url, '?') THEN '&channel=' ELSE '?channel=' END
        || CASE WHEN page_id % 7 = 0 THEN '' ELSE 'c' || (page_id % 50) END
        || CASE WHEN page_id % 5 = 0 THEN '&src=10.0.0.1:8080' ELSE '' END
        || ' HTTP/1.1' AS line FROM pages"""),
}
