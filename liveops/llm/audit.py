"""What filters remove alone, together and in every order, from one pass over the documents.

Each document gets a mask of the filters it fails. For every mask, label and order of the
filters a document takes one way: kept after a step, removed at it, or failing a filter that
no longer sees it. All these outcomes of a mask are one big integer: a field of 64 bits for
each order, step and count. A part's table is the sum of the integers of its documents.

Rows are counted by part, mask and labels where they are read, so a part has at most
``2 ** (filters + 2)`` counts; a part's integer is the sum of (count times integer of the mask).
No field can run over into the next: it holds at most the number of the part's rows, which
Spark's own sum keeps below 2 ** 63.

Copies have a 256-bit hash of the text in common. Rows are counted by it before the shuffle, so
a text of a third of all rows is a few rows of each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The filters: few words, few distinct words, capitals, marks, copies.
FILTERS = "ABCDE"
COPY = FILTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Bits of a field; a count of Spark has 63.
FIELD = 64

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
MARKS = r"[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text alone decides (A to D); a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    size = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        size < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < size * MIN_DISTINCT,
        capitals * 100 > F.length(text) * MAX_CAPITALS,
        text.rlike(MARKS),
    ]
    return reduce(lambda a, b: a + b, [
        F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)
    ])


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, good and toxic of ``labels``; one row per id, true if any of its rows says so."""
    def any_one(column: str) -> Column:
        return F.coalesce(F.bool_or(F.col(column) == 1), F.lit(False))

    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        any_one("quality").alias("good"), any_one("toxic").alias("bad")
    )


def _rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, part, mask, digest, good, bad, n), one for each doc_id, part and text."""
    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    ).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    return rows.join(labelled(labels), "doc_id", "left").fillna(False, ["good", "bad"])


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, bad, n): rows of ``docs`` by the filters they fail, copies included.

    A row fails as a copy if some row of equal text has a smaller doc_id. A null doc_id is
    neither smaller nor larger than another: such rows are no copies and have none.
    """
    kinds = ["part", "mask", "good", "bad"]
    groups = _rows(docs, labels).groupBy(
        "digest", *kinds, F.col("doc_id").isNull().alias("anonymous")
    ).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least")
    )
    # A digest has few rows by now, at most eight for each part.
    first = F.col("least") == F.min("least").over(W.partitionBy("digest"))
    passed = F.when(F.col("anonymous"), F.col("n")).when(first, F.col("at_least")).otherwise(0)
    both = F.array(
        F.struct("mask", F.col("passed").alias("n")),
        F.struct((F.col("mask") + (1 << COPY)).alias("mask"), (F.col("n") - F.col("passed")).alias("n")),
    )
    split = groups.withColumn("passed", passed).select("part", "good", "bad", F.inline(both))
    return split.where("n > 0").groupBy(*kinds).agg(F.sum("n").alias("n"))


ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The counts of a step that a document adds to by itself; shapley is summed from them.
_FIELDS = COUNTS[:-1]


def packed(mask: int, good: bool, bad: bool) -> int:
    """The outcomes of a document of ``mask`` at all steps of all orders, a field each."""
    out = np.zeros((len(ORDERS), len(FILTERS), len(_FIELDS)), "<u8")
    for o, order in enumerate(ORDERS):
        gone = False
        for step, name in enumerate(order):
            fails = bool(mask >> FILTERS.index(name) & 1)
            removed = fails and not gone
            alone = mask == 1 << FILTERS.index(name)
            gone |= fails
            out[o, step] = [not gone, removed, fails and not removed, alone, removed and good, removed and bad]
    return int.from_bytes(out.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counts by order, step and kind of a sum of ``packed`` integers, with shapley added."""
    shape = (len(ORDERS), len(FILTERS), len(_FIELDS))
    size = int(np.prod(shape))
    counts = np.frombuffer(total.to_bytes(size * FIELD // 8, "little"), "<u8").reshape(shape).astype(np.int64)
    removed = counts[:, :, _FIELDS.index("removed")]
    filters = np.array([[FILTERS.index(name) for name in order] for order in ORDERS])
    sums = np.zeros(len(FILTERS), np.int64)
    np.add.at(sums, filters, removed)
    return np.concatenate([counts, sums[filters][:, :, None]], 2)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every filter at every step of every order, for each part of ``docs``.

    ``docs`` has doc_id, text, lang; ``labels`` doc_id, quality, toxic. A part is a value of
    lang, null as the empty string; each has a row for every order and step, and an empty table
    has no parts. Every row of ``docs`` counts, also one that repeats. A null text is empty and
    fails A alone, and E where an empty text of a smaller doc_id exists. Labels of an id that
    repeats count if any row has them; labels of a null id are nobody's. Other columns are ignored.
    """
    parts = counted(docs.select("doc_id", "text", "lang"), labels).groupBy("part").agg(
        # At most 2 ** (filters + 2) rows.
        F.collect_list(F.struct("mask", "good", "bad", "n")).alias("counts")
    )
    names = [order for order in ORDERS for _ in FILTERS]
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        for batch in batches:
            for part, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "counts")), strict=True):
                total = 0
                for row in counts:
                    kind = (row["mask"], row["good"], row["bad"])
                    if kind not in known:
                        known[kind] = packed(*kind)
                    total += row["n"] * known[kind]
                table = unpacked(total).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(table), pa.string()), pa.array(names), pa.array(steps),
                     *[pa.array(column) for column in table.T]],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    counts = ", ".join(f"{name} long" for name in COUNTS)
    return parts.mapInArrow(run, f"part string, filter_order string, step int, {counts}")
