"""Preference pairs of conversations: one prompt, and a masked completion for each side.

The prompt is the longest common prefix of turns (equal role and text) of the chosen and the
rejected conversation, rendered once; the turns after it are the completions. A completion is a
list of segments with a flag: what an assistant says, with its end mark, is trained on; role
headers and the turns of others are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the chat format.
START, STOP = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    # A mark inside a text must not end a turn.
    text = F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(text, F.lit(STOP + "\n"))


def render(turns: Column) -> Column:
    """A list of turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def segments(turns: Column) -> Column:
    """A list of turns as array<struct<text, trained>>, whose texts join to ``render``."""

    def of(turn: Column) -> Column:
        says = F.coalesce(turn["role"] == TRAINED, F.lit(False))
        return F.array(
            F.struct(_header(turn).alias("text"), F.lit(False).alias("trained")),
            F.struct(_body(turn).alias("text"), says.alias("trained")),
        )

    return F.flatten(F.transform(turns, of))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns (array<struct<turn, role, text>> in order) of conversation rows.

    Rows that repeat count once; rows that share a turn number stand by role, then text. Rows
    without a conv_id take no part.
    """
    turn = F.struct("turn", "role", "text")
    return rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.array_sort(F.collect_set(turn)).alias("turns")
    )


def same_opening(talks: DataFrame) -> DataFrame:
    """Pairs of conversations that open with the same turn.

    Of each such group the conversation with most turns (then the least conv_id) is chosen, and
    each other one is rejected once: as many pairs as conversations, not all pairs of a group.
    """
    first = F.struct(F.col("turns")[0]["role"].alias("role"), F.col("turns")[0]["text"].alias("text"))
    opened = talks.withColumn("opening", F.sha2(F.to_json(first), 256))
    best = opened.groupBy("opening").agg(
        F.max(F.struct(F.size("turns").alias("n"), (-F.col("conv_id")).alias("id"))).alias("best"),
        F.count("*").alias("n"),
    ).where("n > 1").select("opening", (-F.col("best.id")).alias("chosen_id"))
    rejected = opened.join(best, "opening").where("conv_id <> chosen_id").select(
        "chosen_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected")
    )
    chosen = talks.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    return rejected.join(chosen, "chosen_id").select("chosen_id", "rejected_id", "chosen", "rejected")


def swapped_reply(talks: DataFrame) -> DataFrame:
    """Pairs of a conversation and itself with the last text of the conversation of the next id."""
    donor = talks.select(
        (F.col("conv_id") - 1).alias("conv_id"), F.col("conv_id").alias("rejected_id"),
        F.element_at("turns", -1)["text"].alias("reply"),
    )
    last = F.element_at("turns", -1)
    other = F.array(F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.col("reply").alias("text")))
    return talks.join(donor, "conv_id").select(
        F.col("conv_id").alias("chosen_id"), "rejected_id", F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", 1, F.size("turns") - 1), other).alias("rejected"),
    )


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (chosen, rejected: lists of turns; other columns stay) in the chat format.

    Adds prefix_turns, prompt, chosen_text and rejected_text (the rendered completions),
    chosen_segments and rejected_segments, and drops the lists. A prompt is empty if the first
    turns differ; a completion is empty if that side is the prefix of the other. Pairs whose
    sides are equal, empty or null hold no preference and are left out. Null roles and texts
    render as empty.
    """
    say = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    same = F.zip_with("chosen", "rejected", lambda a, b: say(a).eqNullSafe(say(b)) & a.isNotNull() & b.isNotNull())
    found = pairs.where("chosen IS NOT NULL AND rejected IS NOT NULL").withColumn(
        "prefix_turns", (F.array_position(same, False) - 1).cast("int")
    ).where("prefix_turns >= 0")
    rest = {c: F.slice(c, F.col("prefix_turns") + 1, F.size(c)) for c in ("chosen", "rejected")}
    keep = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    return found.select(
        *keep, "prefix_turns", render(F.slice("chosen", 1, F.col("prefix_turns"))).alias("prompt"),
        *[render(rest[c]).alias(f"{c}_text") for c in rest],
        *[segments(rest[c]).alias(f"{c}_segments") for c in rest],
    )


def mask(parts: Column) -> Column:
    """Segments as signed lengths: -12+40 stands for 12 characters left out and 40 trained on."""
    sign = lambda s: F.when(s["trained"], "+").otherwise("-")
    return F.array_join(F.transform(parts, lambda s: F.concat(sign(s), F.length(s["text"]).cast("string"))), "")
