"""Servers of the fleet and their status over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liveops.operators import keyed, validate
from liveops.operators.ordered import ordered, previous

CONFIG_SCHEMA = (
    "streamsrvlist array<struct<IP string, ISP string, region string, regionID int, "
    "concurrency int, bandwidth bigint, areaID int>>"
)
STATUS_SCHEMA = (
    "code int, cpu_occupy double, mem_occupy double, "
    "net struct<received_bytes bigint, transmited_bytes bigint, received_packets bigint, "
    "transmited_packets bigint>, viewers struct<total bigint>, "
    "channels struct<total bigint, viewers map<string, bigint>, `set` array<string>>, "
    "cameras struct<total bigint, `set` array<string>>, "
    "resources struct<total bigint, `set` array<string>>"
)
HEARTBEAT_SCHEMA = (
    "version string, concurrency int, areaID int, uptime bigint, machineroom string, "
    "streamips array<string>"
)
HEARTBEAT_FIELDS = ("version", "concurrency", "areaID", "uptime", "machineroom", "streamips")


def servers(spark: SparkSession, path: str, area: int | None = None) -> DataFrame:
    """Servers listed in fleet config files, one row each."""
    listed = spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True)
    rows = listed.select(F.explode("streamsrvlist").alias("s")).select(
        "s.IP", "s.ISP", "s.region", "s.regionID", "s.concurrency", "s.bandwidth", "s.areaID"
    )
    return by_area(rows, area)


def by_area(df: DataFrame, area: int | None = None) -> DataFrame:
    return df if area is None else df.where(F.col("areaID") == area)


def snapshots(raw: DataFrame, body: str = "body", schema: str = STATUS_SCHEMA) -> DataFrame:
    """Status documents that parsed and are no error replies."""
    rows = validate.parsed(raw, body, schema)
    return rows.where(F.col("code").isNull() & F.col("_corrupt").isNull()).drop("code", "_corrupt")


def heartbeats(raw: DataFrame, order, body: str = "body", schema: str = HEARTBEAT_SCHEMA,
               required=HEARTBEAT_FIELDS) -> DataFrame:
    """Latest complete heartbeat per ``sender``."""
    accepted, _ = validate.split(validate.parsed(raw, body, schema), required)
    return keyed.latest(accepted.drop("_corrupt"), "sender", order)


def with_status(fleet: DataFrame, latest: DataFrame) -> DataFrame:
    """Every configured server with its latest status, if any; both have a row per server."""
    return fleet.join(latest, "server", "left")


def _delta(name: str) -> Column:
    change = F.col(name) - F.col(f"_{name}")
    return F.when(change >= 0, change)


def rates(df: DataFrame, counters, idle: str | None = None, busy_total: str | None = None,
          order=("us", "event_id")) -> DataFrame:
    """Counter rates per second and occupancy between neighbouring snapshots of a server.

    A counter that fell was reset: its rate is null.
    """
    used = [*counters, *([idle, busy_total] if idle else [])]
    rows = ordered(df, ["server"], order).running(
        _us=previous("us"), **{f"_{c}": previous(c) for c in used}
    )
    seconds = (F.col("us") - F.col("_us")) / 1e6
    out = {f"{c}_per_s": F.when(seconds > 0, _delta(c) / seconds) for c in counters}
    if idle:
        spent = F.col(busy_total) - F.col(f"_{busy_total}")
        out["occupancy"] = F.when(spent > 0, 1 - _delta(idle) / spent)
    return rows.map(out).result("_us", *[f"_{c}" for c in used])


def status_document(df: DataFrame) -> Column:
    """Nested status text of one server per row.

    Takes scalar columns and ``channel_viewers``, an array of (channel, viewers);
    admission bounds the channels of a server, hence the document.
    """
    have = set(df.columns)

    def nested(name, **fields):
        present = [F.col(c).alias(f) for f, c in fields.items() if c in have]
        return [F.struct(*present).alias(name)] if present else []

    channels = []
    if "channel_viewers" in have:
        channels = [
            F.struct(
                F.size("channel_viewers").cast("bigint").alias("total"),
                F.map_from_entries("channel_viewers").alias("viewers"),
                F.transform("channel_viewers", lambda e: e[df.schema["channel_viewers"].dataType
                            .elementType.fieldNames()[0]]).alias("set"),
            ).alias("channels")
        ]
    plain = [c for c in ("cpu_occupy", "mem_occupy") if c in have]
    return F.to_json(
        F.struct(
            *plain,
            *nested("net", received_bytes="received_bytes", transmited_bytes="transmited_bytes",
                    received_packets="received_packets", transmited_packets="transmited_packets"),
            *nested("viewers", total="viewers_total"),
            *channels,
        )
    )


def status_json(channel_viewers: DataFrame) -> DataFrame:
    """One status document per ``server`` from rows (server, channel, viewers)."""
    entry = F.struct(F.col("channel").cast("string").alias("channel"), F.col("viewers"))
    rows = channel_viewers.groupBy("server").agg(
        F.sum("viewers").alias("viewers_total"),
        F.sort_array(F.collect_list(entry)).alias("channel_viewers"),
    )
    return rows.select("server", status_document(rows).alias("doc"))


#: Sections of a status document: head, viewers by channel, what is between, channels, end.
HEAD, VIEWERS, MIDDLE, SET, END = range(5)


def status_lines(channel_viewers: DataFrame) -> DataFrame:
    """The documents of ``status_json`` as lines (server, section, channel, line), of any size.

    In the order of these columns the lines of a server make its document. Nothing is gathered
    per server but its totals; its lines are one sorted window partition, which spills. One row per server and channel; a null
    channel or server is left out, a null count of viewers is 0.
    """
    rows = channel_viewers.select(
        "server", F.col("channel").cast("string").alias("channel"),
        F.coalesce(F.col("viewers").cast("bigint"), F.lit(0)).alias("viewers"),
    ).where("server IS NOT NULL AND channel IS NOT NULL")
    totals = rows.groupBy("server").agg(
        F.sum("viewers").alias("total"), F.count(F.lit(1)).alias("n")
    )

    def section(number: int, line: Column) -> Column:
        return F.struct(F.lit(number).alias("section"), line.alias("line"))

    frame = F.array(
        section(HEAD, F.format_string(
            '{"viewers":{"total":%d},"channels":{"total":%d,"viewers":{', "total", "n"
        )),
        section(MIDDLE, F.lit('},"set":[')),
        section(END, F.lit("]}}")),
    )
    # A text as JSON writes it, from a list of that text alone.
    listed = F.to_json(F.array("channel"))
    name = F.substring(listed, F.lit(2), F.length(listed) - 2)
    entry = F.array(
        section(VIEWERS, F.concat(name, F.lit(":"), F.col("viewers").cast("string"))),
        section(SET, name),
    )
    lines = rows.select("server", "channel", F.explode(entry).alias("_line")).unionByName(
        totals.select("server", F.lit("").alias("channel"), F.explode(frame).alias("_line"))
    ).select("server", "_line.section", "channel", "_line.line")
    before = F.lag("section").over(Window.partitionBy("server").orderBy("section", "channel"))
    comma = F.when(before == F.col("section"), ",").otherwise("")
    return lines.withColumn("line", F.concat(comma, "line"))


def write_status(channel_viewers: DataFrame, path: str) -> None:
    """A document per server as the one text file of ``path/server=…``.

    A server's lines are written one by one in the order of their window, so the size of a
    document is bounded by no memory.
    """
    # The window keeps a server in one task; a repartition adaptive execution may undo.
    (
        status_lines(channel_viewers).sortWithinPartitions("server", "section", "channel")
        .select("server", F.col("line").alias("value"))
        .write.partitionBy("server").text(path)
    )
