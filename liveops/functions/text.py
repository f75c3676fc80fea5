"""Request lines, addresses, chat lines and records as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def first_value_map(keys: Column, values: Column) -> Column:
    """Map where the first value of a repeated key stays."""
    return F.map_from_arrays(
        F.array_distinct(keys),
        F.transform(
            F.array_distinct(keys),
            lambda k: F.element_at(values, F.array_position(keys, k).cast("int")),
        ),
    )


# Fixed pattern: method, path, arguments, version.
REQUEST_LINE = r"^([^ ]*) +([^ ?=]*)(\?[^ ]*)? +(?:http|HTTP)/([^\r\n]*)(?:\r\n)?$"


def request_line(line) -> Column:
    """Struct (method, path, args, version) of a request line, null when malformed."""
    line = _col(line)

    def part(n):
        return F.regexp_extract(line, REQUEST_LINE, n)

    pieces = F.filter(
        F.split(F.regexp_replace(part(3), r"^\?", ""), "&"), lambda p: p != F.lit("")
    )
    keys = F.transform(pieces, lambda p: F.substring_index(p, "=", 1))
    values = F.transform(pieces, lambda p: F.regexp_replace(p, r"^[^=]*=?", ""))
    return F.when(
        line.rlike(REQUEST_LINE),
        F.struct(
            part(1).alias("method"),
            part(2).alias("path"),
            first_value_map(keys, values).alias("args"),
            part(4).alias("version"),
        ),
    )


def last_segment(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def host_port(address, default: int = 80) -> Column:
    """Struct (host, port); the default port where none or no number is given."""
    part = F.split(_col(address), ":")
    port = F.coalesce(F.get(part, F.lit(1)).try_cast("int"), F.lit(default))
    return F.struct(F.get(part, F.lit(0)).alias("host"), port.alias("port"))


# What a chat line says of a speaker.
JOINED, SAYS, QUIT, CLOSED = "加入聊天室", "说", "已退出聊天室", "关闭了浏览器"


def chat_line(when, speaker, event, text) -> Column:
    """``time speaker joined | says: text | quit`` for event join, say, quit or close."""
    head = F.concat_ws(" ", _col(when), _col(speaker))
    event = _col(event)
    return (
        F.when(event == "join", F.concat_ws(" ", head, F.lit(JOINED)))
        .when(event == "quit", F.concat_ws(" ", head, F.lit(QUIT)))
        .when(event == "close", F.concat_ws(" ", head, F.lit(CLOSED)))
        .otherwise(F.concat(head, F.lit(f" {SAYS}: "), _col(text)))
    )


def chat_arguments(line) -> Column:
    """Struct (channel, name) from the query string of a chat request."""
    query = F.substring_index(_col(line), "?", -1)

    def value(key):
        return F.regexp_extract(query, rf"(?:^|&){key}=([^& ]*)", 1)

    return F.struct(value("channel").alias("channel"), value("name").alias("name"))


def invitee_record(member, rest) -> Column:
    """Invitee record with the id padded to ten places."""
    return F.format_string("V:1:%10d:%s", _col(member), _col(rest))
