"""Media tags, frames and transport packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.functions.binary import uint
from liveops.functions.levels import TICKS_PER_SECOND
from liveops.operators.joins import overlapping
from liveops.operators.ordered import highest, latest, ordered, position, previous, total

ARRIVAL = ["us", "event_id"]
# Tag types, codecs and the key-frame type of FLV.
AUDIO, VIDEO, SCRIPT = 8, 9, 18
AAC, AVC, KEY_FRAME = 10, 7, 1
SAMPLES_PER_AUDIO_FRAME, VIDEO_FIRST = 1024, {"video": 0, "audio": 1}


def classify(tags: DataFrame, kind: str = "type", data: str = "data") -> DataFrame:
    """Kind of each tag, key frame, sequence header, and whether the codec is handled."""
    tag = F.col(kind).bitwiseAND(0x1F)
    first, second = uint(data, 0, 1), uint(data, 1, 1)
    high, low = F.shiftright(first, 4), first.bitwiseAND(0x0F)
    audio, video, script = tag == AUDIO, tag == VIDEO, tag == SCRIPT
    codec_ok = (
        F.when(audio, high == AAC).when(video, low == AVC).when(script, True).otherwise(False)
    )
    header = F.when(script, True).otherwise(codec_ok & (second == 0))
    return tags.withColumns(
        {
            "kind": F.when(audio, "audio").when(video, "video").when(script, "script"),
            "is_key": F.coalesce(video & (high == KEY_FRAME), F.lit(False)),
            "is_header": F.coalesce(header, F.lit(False)),
            "codec_ok": F.coalesce(codec_ok, F.lit(False)),
        }
    )


# delivery ------------------------------------------------------------------------------
def deliver(tags: DataFrame, spans: DataFrame, cell: int) -> DataFrame:
    """One copy of each tag, headers aside, per viewer watching then.

    The result is as large as the deliveries; ask ``delivered`` for totals.
    """
    return overlapping(
        tags.where(~F.col("is_header")), spans, "channel", "us", cell, "from_us", "to_us"
    )


def delivered(tags: DataFrame, spans: DataFrame) -> DataFrame:
    """Copies and bytes each viewing span got, as differences of running totals."""
    zero = F.lit(0).cast("bigint")
    body = tags.where(~F.col("is_header")).select(
        "channel", "us", F.lit(1).alias("_side"), "event_id",
        F.lit(1).cast("bigint").alias("_n"), F.col("size").alias("_b"),
    )
    # Ends sort before tags of their time: a span covers from <= us < to.
    edge = F.explode(
        F.array(
            F.struct(F.col("from_us").alias("us"), F.lit(-1).alias("_sign")),
            F.struct(
                F.coalesce("to_us", F.lit(2**63 - 1)).alias("us"), F.lit(1).alias("_sign")
            ),
        )
    )
    edges = spans.select("channel", "client", "from_us", "to_us", "from_id", edge.alias("_e")).select(
        "channel", "_e.us", F.lit(0).alias("_side"), F.col("from_id").alias("event_id"),
        F.struct("client", "from_us", "to_us", "from_id", "_e._sign").alias("_span"),
    )
    rows = ordered(
        body.unionByName(edges, allowMissingColumns=True), ["channel"], ["us", "_side", "event_id"]
    ).running(_copies=total("_n"), _bytes=total("_b"))
    sign = F.col("_span._sign")
    return (
        rows.df.where(F.col("_side") == 0)
        .groupBy("channel", "_span.client", "_span.from_us", "_span.to_us", "_span.from_id")
        .agg(
            F.sum(sign * F.coalesce("_copies", zero)).alias("copies"),
            F.sum(sign * F.coalesce("_bytes", zero)).alias("bytes"),
        )
    )


def headers_at_join(headers: DataFrame, joins: DataFrame, kinds) -> DataFrame:
    """For each join the last header of every kind before it: ``<kind>_id`` or null."""
    both = joins.select(
        "channel", *ARRIVAL, F.lit(1).alias("_side"), F.col("client").alias("client")
    ).unionByName(
        headers.select(
            "channel", *ARRIVAL, F.lit(0).alias("_side"), F.col("kind").alias("_kind"),
            F.col("event_id").alias("_id"),
        ),
        allowMissingColumns=True,
    )
    rows = ordered(both, ["channel"], ["us", "_side", "event_id"]).running(
        **{f"{k}_id": latest(F.when(F.col("_kind") == k, F.col("_id"))) for k in kinds}
    )
    return rows.df.where(F.col("_side") == 1).select(
        "channel", "client", *ARRIVAL, *[f"{k}_id" for k in kinds]
    )


# frames ----------------------------------------------------------------------------------
def interleave(frames: DataFrame, sample_rate: int, frame_rate: int, keys=("channel",)) -> DataFrame:
    """Synthetic presentation time per track and the place in the joint output.

    Audio goes out while it is behind video, so at equal times video is first.
    """
    clock = TICKS_PER_SECOND["90khz"]
    audio, video = SAMPLES_PER_AUDIO_FRAME * clock // sample_rate, clock // frame_rate
    rows = ordered(frames, [*keys, "track"], ARRIVAL).running(_seen=position())
    step = F.when(F.col("track") == "audio", audio).otherwise(video)
    turn = F.when(F.col("track") == "video", 0).otherwise(1)
    timed = rows.map({"pts": (F.col("_seen") - 1) * step, "_turn": turn}).result("_seen")
    placed = ordered(timed, keys, ["pts", "_turn", "event_id"]).running(place=position())
    return placed.result("_turn")


def keyframe_cut(frames: DataFrame, keys=("channel", "segment")) -> DataFrame:
    """Frames of each segment from its first key frame on."""
    rows = ordered(frames, keys, ARRIVAL).running(_key=highest(F.col("is_key").cast("int")))
    return rows.df.where(F.col("_key") == 1).drop("_key", "_block")


# transport packets ---------------------------------------------------------------------------
def continuity(packets: DataFrame, keys=("pid",), order=("us", "event_id")) -> DataFrame:
    """Whether the 4-bit counter of each packet follows its predecessor's."""
    rows = ordered(packets, keys, order).running(_cc=previous("cc"))
    broken = F.pmod(F.col("cc") - F.col("_cc"), F.lit(16)) != 1
    return rows.map({"broken": F.coalesce(broken, F.lit(False))}).result("_cc")


def refresh_gaps(tables: DataFrame, limit_us: int, keys=("pid",), order=("us", "event_id")) -> DataFrame:
    """Time since the last refresh of each periodic table and whether it is in the limit."""
    rows = ordered(tables, keys, order).running(_us=previous("us"))
    gap = F.col("us") - F.col("_us")
    return rows.map(
        {"gap_us": gap, "in_time": F.coalesce(gap <= limit_us, F.lit(True))}
    ).result("_us")
