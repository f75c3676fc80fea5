"""Media files to rows: FLV tags, MP4 boxes and tracks, transport packets, frames.

These forms take whole files as values, from ``binaryFile`` or a table: for corpora of small
files, and stores that only Spark reads. ``slices`` reads large files by ranges, with the same
walks (``records``) and the same rows. A damaged file gives the rows up to the damage and a last
row that says what is wrong; transport streams go on at the next packet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from liveops.sources.records import FORMATS, TS_SCHEMA, Bytes, batch_ts

SUFFIXES = {".mp4": "mp4", ".flv": "flv", ".ts": "ts"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with their kind by suffix, null for others."""
    kind = F.lit(None).cast("string")
    for suffix, name in SUFFIXES.items():
        kind = F.when(F.lower("path").endswith(suffix), name).otherwise(kind)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.select("path", "length", kind.alias("kind"), "content")


def _rows(df: DataFrame, parse, schema: str, kind: str | None, batch: int = 4096) -> DataFrame:
    """``parse`` each file's bytes into rows, sent on in small Arrow batches."""
    struct = StructType.fromDDL(f"path string, {schema}")
    arrow = to_arrow_schema(struct)
    fields = list(arrow)[1:]

    def table(made):
        columns = [pa.array([path for path, _ in made], pa.string())]
        columns += [pa.array([r.get(f.name) for _, r in made], f.type) for f in fields]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches):
        for held in batches:
            # Rows of many small files share a batch; a large file fills several.
            rows = (
                (path.as_py(), row)
                for path, content in zip(held.column("path"), held.column("content"))
                for row in parse(Bytes(content.as_py()))
            )
            while made := list(islice(rows, batch)):
                yield table(made)

    chosen = df.where(F.col("kind") == kind) if kind else df
    return chosen.select("path", "content").mapInArrow(run, struct)


def _walked(name: str):
    """The rows of a whole file, numbered."""

    def parse(source: Bytes) -> Iterator[dict]:
        walk = FORMATS[name].walk(source, 0, False, source.length)
        rows = (row for block in walk for row in block)
        return ({"pos": pos, **row} for pos, row in enumerate(rows))

    return parse


# FLV --------------------------------------------------------------------------------------
def flv_tags(df: DataFrame) -> DataFrame:
    """One row per tag; frame type, codec and packet type from the first body bytes."""
    return with_codecs(_rows(df, _walked("flv"), FORMATS["flv"].schema, "flv"))


def with_codecs(rows: DataFrame) -> DataFrame:
    """Tags with frame type, codec and packet type from the first bytes of their bodies."""
    from liveops.functions.binary import uint

    first, second = uint("data", 0, 1), uint("data", 1, 1)
    audio, video = F.col("type") == 8, F.col("type") == 9
    return rows.withColumns(
        {
            "frame_type": F.when(video, F.shiftright(first, 4)).cast("int"),
            "codec": F.when(video, first.bitwiseAND(15)).when(audio, F.shiftright(first, 4))
            .cast("int"),
            "packet_type": F.when(
                (video & (first.bitwiseAND(15) == 7)) | (audio & (F.shiftright(first, 4) == 10)),
                second,
            ).cast("int"),
        }
    )


# MP4 --------------------------------------------------------------------------------------
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta")
MP4_SCHEMA = "depth int, box string, offset bigint, size bigint, track int, data binary, error string"
KEPT = (b"mdhd", b"hdlr", b"tkhd", b"mvhd", b"ftyp")


def parse_mp4(source: Bytes) -> Iterator[dict]:
    """Every box depth first; small header boxes with their body. Other bodies are not read."""
    spans, track = [(0, source.length, 0, None)], 0
    while spans:
        at, end, depth, owner = spans.pop()
        if at >= end:
            continue
        if at + 8 > end:
            yield {"depth": depth, "offset": at, "track": owner, "error": "box header cut"}
            return
        size, name, head = source.number(at, 4), source.get(at + 4, 4), 8
        if size == 1:
            if at + 16 > end:
                yield {"depth": depth, "offset": at, "track": owner, "error": "box header cut"}
                return
            size, head = source.number(at + 8, 8), 16
        elif size == 0:
            size = end - at
        label = name.decode("latin-1")
        if size < head or at + size > end:
            yield {"depth": depth, "box": label, "offset": at, "size": size, "track": owner,
                   "error": "box does not fit"}
            return
        mine = owner
        if name == b"trak":
            track += 1
            mine = track
        body = source.get(at + head, size - head) if name in KEPT else None
        yield {"depth": depth, "box": label, "offset": at, "size": size, "track": mine,
               "data": body}
        spans.append((at + size, end, depth, owner))
        if name in CONTAINERS:
            spans.append((at + head, at + size, depth + 1, mine))


def mp4_boxes(df: DataFrame) -> DataFrame:
    return _rows(df, parse_mp4, MP4_SCHEMA, "mp4")


def mp4_tracks(boxes: DataFrame) -> DataFrame:
    """Timescale, duration, language and handler of each track."""
    from liveops.functions.binary import uint

    wide = uint("data", 0, 1) == 1
    letters = [
        F.char(F.shiftright(F.when(wide, uint("data", 32, 2)).otherwise(uint("data", 20, 2)), s)
               .bitwiseAND(31) + 0x60)
        for s in (10, 5, 0)
    ]
    media, handler = F.col("box") == "mdhd", F.col("box") == "hdlr"
    scale = F.when(wide, uint("data", 20, 4)).otherwise(uint("data", 12, 4))
    length = F.when(wide, uint("data", 24, 8)).otherwise(uint("data", 16, 4))
    return (
        boxes.where(F.col("track").isNotNull() & (media | handler))
        .groupBy("path", "track")
        .agg(
            F.max(F.when(media, scale)).alias("timescale"),
            F.max(F.when(media, length)).alias("duration"),
            F.max(F.when(media, F.concat(*letters))).alias("language"),
            F.max(F.when(handler, F.decode(F.substring("data", 9, 4), "US-ASCII"))).alias("handler"),
        )
    )


# transport stream ---------------------------------------------------------------------------
def ts_packets(df: DataFrame, step: int = 1 << 16) -> DataFrame:
    """Header fields of every 188-byte packet, read as columns of a byte matrix.

    ``error`` marks packets without the sync byte, short of bytes, and a cut last packet.
    """
    struct = StructType.fromDDL(f"path string, {TS_SCHEMA}")
    arrow = to_arrow_schema(struct)

    def run(batches):
        for held in batches:
            parts, count = [], 0
            for path, content in zip(held.column("path"), held.column("content")):
                source, first = Bytes(content.as_py()), 0
                for packets in FORMATS["ts"].walk(source, 0, False, source.length):
                    parts.append((path.as_py(), first, packets))
                    first, count = first + len(packets), count + len(packets)
                    if count >= step:
                        yield batch_ts(parts, arrow)
                        parts, count = [], 0
            if parts:
                yield batch_ts(parts, arrow)

    return df.where(F.col("kind") == "ts").select("path", "content").mapInArrow(run, struct)


# web-socket frames ---------------------------------------------------------------------------
def ws_frames(captures: DataFrame) -> DataFrame:
    """Unmasked text of the frames in each capture (path, content)."""
    return _rows(captures, _walked("ws"), FORMATS["ws"].schema, None)
