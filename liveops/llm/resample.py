"""Documents drawn towards a target corpus by importance weights of hashed word n-grams.

Features are all runs of one and two consecutive words of a text, hashed into ``BUCKETS``. The
gain of a bucket is the log ratio of its smoothed shares in the target and in the documents; a
document's weight is the mean gain of its features, and Gumbel noise from a hash of its doc_id
turns the highest scores into a draw without replacement.

Segment deduplication: a line feed always parts words, so texts are cut into lines. Equal lines
are counted before and after one shuffle, the feature counts of each distinct line are computed
once and written, and are multiplied by how often the line stands. The n-grams that reach over a
line's end are few and are added separately, from the last and first words of neighbouring
lines. Weights go back the same way: a line's gain is summed once from its counts, and joined to
the documents that hold it by a 128-bit hash; a document carries each distinct line once.

The driver sees the counts of ``BUCKETS`` buckets and nothing that grows. Ranks come from
``numbered``: parts of like size over the whole order, no global sort in one task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.llm.words import ALNUM, Words, chunks, split
from liveops.operators.numbered import numbered
from liveops.session import written

BUCKETS = 10_000
#: Words a document needs to be drawn, percent of those that are, and the seed of the noise.
MIN_WORDS, SHARE, SEED = 20, 25, 7
#: What words are made of, before A-Z are lower-cased.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


class _Buckets:
    """Buckets of the words of a chunk and of pairs of them, each distinct one hashed once."""

    def __init__(self, words: Words):
        self.raw = [w.encode() for w in words.words.to_pylist()]
        self.opened = [zlib.crc32(w + b" ") for w in self.raw]
        self.single = np.array([zlib.crc32(w) % BUCKETS for w in self.raw], np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        size = max(1, len(self.raw))
        distinct, back = np.unique(left.astype(np.int64) * size + right, return_inverse=True)
        raw, opened = self.raw, self.opened
        made = [zlib.crc32(raw[p % size], opened[p // size]) % BUCKETS for p in distinct.tolist()]
        return np.array(made, np.int64)[back] if made else np.zeros(0, np.int64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, n) to (key, n, buckets, times): the counts of the features inside each line."""
    for batch in chunks(batches, "line"):
        lines = batch.column("line")
        words = split(lines, ALNUM)
        hashed, owner = _Buckets(words), words.docs
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else owner
        of = np.concatenate([owner, owner[inner]]) * BUCKETS + np.concatenate([
            hashed.single[words.codes], hashed.pairs(words.codes[inner], words.codes[inner + 1]),
        ])
        of, times = np.unique(of, return_counts=True)
        counts = np.bincount(of // BUCKETS, minlength=len(lines))
        keys = [hashlib.md5(line.as_buffer()).digest() for line in lines.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), batch.column("n"), _lists(of % BUCKETS, counts, pa.int32()),
             _lists(times, counts, pa.int32())],
            names=["key", "n", "buckets", "times"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to words, buckets of pairs across lines, and keys of the distinct lines."""
    for batch in chunks(batches):
        lists = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        # The distinct lines of a chunk are split into words once.
        words = split(coded.dictionary, ALNUM)
        counts = words.counts
        full = counts[codes] > 0
        owner = np.repeat(np.arange(len(lists)), np.diff(ends))[full]
        codes = codes[full]
        size = np.bincount(owner, counts[codes], len(lists)).astype(np.int64)
        neighbours = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else owner
        last = words.codes[words.offsets[codes[neighbours] + 1] - 1]
        first = words.codes[words.offsets[codes[neighbours + 1]]]
        cross = _Buckets(words).pairs(last, first)
        held, times = np.unique(owner * max(1, len(counts)) + codes, return_counts=True)
        digests = np.array([hashlib.md5(line.as_buffer()).digest() for line in
                            coded.dictionary.cast(pa.binary())], object)
        keys = digests[held % max(1, len(counts))] if len(held) else digests[:0]
        per_doc = np.bincount(held // max(1, len(counts)), minlength=len(lists))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(size),
                _lists(cross, np.bincount(owner[neighbours], minlength=len(lists)), pa.int32()),
                _lists(keys, per_doc, pa.binary()), _lists(times, per_doc, pa.int32()),
            ],
            names=["doc_id", "n_words", "cross", "keys", "times"],
        )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of a task's lines by bucket: a row for each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        times = batch.column("times")
        n = np.repeat(batch.column("n").to_numpy(), pc.list_value_length(times).to_numpy())
        np.add.at(total, batch.column("buckets").flatten().to_numpy(), times.flatten().to_numpy() * n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total)], names=["bucket", "n"]
    )


@dataclass(frozen=True)
class Segments:
    """The distinct lines of a corpus with their feature counts, and what its documents hold."""

    lines: DataFrame
    docs: DataFrame

    def counts(self) -> np.ndarray:
        """Features of the whole corpus by bucket."""
        inside = self.lines.select("n", "buckets", "times").mapInArrow(_sums, "bucket int, n long")
        across = self.docs.select(F.explode("cross").alias("bucket")).groupBy("bucket").agg(
            F.count("*").alias("n")
        )
        out = np.zeros(BUCKETS, np.int64)
        # At most ``BUCKETS`` rows.
        for row in inside.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[row.bucket] = row.n
        return out


def segments(docs: DataFrame) -> Segments:
    """Both tables for ``docs`` (doc_id, text); a null text has no words."""
    lines = (
        docs.select(F.explode(F.split("text", "\n")).alias("line"))
        .where(F.col("line").rlike(_WORD))
        .groupBy("line").agg(F.count("*").alias("n"))
    )
    lines = lines.mapInArrow(_features, "key binary, n long, buckets array<int>, times array<int>")
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _cut, "doc_id long, n_words long, cross array<int>, keys array<binary>, times array<int>"
    )
    # Written with its numbers, a row keeps its number whatever is computed again.
    return Segments(written(lines), written(cut.withColumn("row", F.monotonically_increasing_id())))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the floor of 1000 times the log ratio of its smoothed shares."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([
        math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t)))
        for a, b in zip(source, target, strict=True)
    ], np.int64)


def _gained(gain: np.ndarray, names: list[str], buckets: str, times: str | None):
    """A map of batches to the columns ``names`` and ``gain``, the sum over a row's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(buckets)
            each = gain[lists.flatten().to_numpy()]
            if times:
                each = each * batch.column(times).flatten().to_numpy()
            upto = np.concatenate(([0], np.cumsum(each)))
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            sums = upto[ends[1:]] - upto[ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sums)], names=[*names, "gain"]
            )

    return run


def weighed(docs: Segments, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every document."""
    lines = docs.lines.select("key", "buckets", "times").mapInArrow(
        _gained(gain, ["key"], "buckets", "times"), "key binary, gain long"
    )
    own = docs.docs.select("row", "doc_id", "n_words", "cross").mapInArrow(
        _gained(gain, ["row", "doc_id", "n_words"], "cross", None),
        "row long, doc_id long, n_words long, gain long",
    )
    held = docs.docs.select("row", F.explode(F.arrays_zip("keys", "times")).alias("line")).select(
        "row", F.col("line.keys").alias("key"), F.col("line.times").alias("often")
    )
    inside = held.join(lines, "key").select("row", (F.col("gain") * F.col("often")).alias("gain"))
    total = own.unionByName(inside, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("gain").alias("gain")
    )
    features = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    return total.withColumn("n_features", features).withColumn(
        "weight",
        F.when(F.col("n_features") == 0, 0)
        .otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features")).cast("long"),
    ).drop("gain")


def noise(doc_id: str = "doc_id"):
    """The floor of 1000 times a Gumbel value from a hash of the id; a null id as no digits."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text).

    Of the rows with ``MIN_WORDS`` words the ``SHARE`` percent of highest score have a rank, from
    1; ties go to the smaller doc_id (a null one before), then to the row read first. A null text
    has no features and weight 0. Rows that repeat are each weighed, and drawn one by one. An
    empty ``target`` (text) has even shares; empty ``docs`` give no rows.
    """
    source = segments(docs)
    gain = gains(source.counts(), segments(target.withColumn("doc_id", F.lit(0))).counts())
    found = written(weighed(source, gain).withColumn("score", F.col("weight") + noise()))
    able = found.where(F.col("n_words") >= MIN_WORDS)
    places = able.select((-F.col("score")).alias("down"), "doc_id", "row")
    drawn = F.floor(able.agg(F.count("*")).scalar() * SHARE / 100)
    ranks = (
        numbered(places, ["down", "doc_id", "row"], "n")
        .where(F.col("n") < drawn)
        .select("row", (F.col("n") + 1).alias("rank"))
    )
    return found.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
