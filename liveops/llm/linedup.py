"""Repeated runs of lines, found on a suffix array of line numbers, with DataFrame functions only.

A document is the sequence of its lines that are not blank. A run is repeated when the same
lines stand consecutively at an earlier place (by doc_id, then line; places may overlap). Every
line inside a repeated run of at least ``min_words`` words goes; ``native`` counts the words of a
line.

Ranks in the suffix array of all lines that occur twice or more come from prefix doubling: the
rank of a place at depth 2h is its rank at depth h, moved by the number of suffixes in the same
interval whose rank h lines on is smaller. A rank and its number of suffixes are an interval of
a longest common prefix of at least that depth. Intervals of one suffix end the doubling there,
and only pairs of ranks that occur twice are ordered, after a grouped count.

A repeated run of enough words is covered by its shortest parts that still have enough words,
taken forward from each line and backward from each line. Such a part has at most ``min_words``
lines, so the depth of doubling is bounded by the parameter. A part of n lines is an
intersection of two intervals of depth 2^k <= n; its earliest place is kept, the others go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liveops.session import written

MIN_WORDS = 50
#: A document: its doc_id (null: the least number) and a hash that tells rows of one doc_id with
#: different texts apart.
DOC = ["doc", "version"]
#: Scripts without blanks: each character counts as a word.
SCRIPTS = "".join(
    rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
)
_WORD = rf"[{SCRIPTS}]|[^\x20\x09-\x0D{SCRIPTS}]+"
#: The same for DuckDB, which names scripts without ``Is``.
SQL_WORD = _WORD.replace("{Is", "{")
#: The same words, faster: no character before U+0E00 is of ``SCRIPTS``, so most need no look at them.
_FAST = (
    rf"[\x00-\x08\x0E-\x1F\x21-\x{{DFF}}[^\x00-\x{{DFF}}{SCRIPTS}]]++"
    rf"|[\x{{E00}}-\x{{10FFFF}}&&[{SCRIPTS}]]"
)


def native(line: Column) -> Column:
    """Words between ASCII white space, and characters of ``SCRIPTS``; a blank line has none."""
    return F.regexp_count(line, F.lit(_FAST))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "doc": F.coalesce("doc_id", F.lit(-(2**63))), "version": F.xxhash64("text", "doc_id"),
    })


def _ranked(docs: DataFrame, words: Callable[[Column], Column]) -> DataFrame:
    """Lines that occur twice or more: place in its document, words, and rank at depth 1."""
    lines = (
        _keyed(docs.select("doc_id", "text")).select(*DOC, F.posexplode(_lines(F.col("text"))))
        .select(
            *DOC, F.col("pos").alias("line"),
            F.xxhash64("col").alias("high"), F.xxhash64(F.lit(1), "col").alias("low"),
            words(F.col("col")).alias("words"),
        )
        .where("words > 0")
        # Rows that repeat a document are one document here.
        .repartition(*DOC)
        .dropDuplicates([*DOC, "line"])
        .withColumn("seq", F.row_number().over(W.partitionBy(*DOC).orderBy("line")))
    )
    lines = written(lines)
    classes = lines.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1")
    classes = classes.withColumn("part", F.shiftright("high", 52))
    # 4,096 parts at most.
    parts = classes.groupBy("part").agg(F.sum("n").alias("total")).withColumn(
        "before", F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    )
    inside = W.partitionBy("part").orderBy("high", "low").rowsBetween(W.unboundedPreceding, -1)
    rank = (
        F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ).alias("rank0")
    ranks = classes.join(F.broadcast(parts), "part").select("high", "low", rank)
    return lines.join(ranks, ["high", "low"]).select(*DOC, "line", "seq", "words", "rank0")


def _doubled(places: DataFrame, depth: int, level: int) -> DataFrame:
    """``places`` with the rank at twice ``depth``, null where that prefix occurs once."""
    doc = W.partitionBy(*DOC).orderBy("seq")
    mine, out = f"rank{level}", f"rank{level + 1}"
    # Lines between that occur once are not in the table: then the row so far on is not theirs.
    ahead = F.when(F.lead("seq", depth).over(doc) == F.col("seq") + depth, F.lead(mine, depth).over(doc))
    places = places.withColumn("ahead", ahead)
    pairs = (
        places.where(F.col(mine).isNotNull() & F.col("ahead").isNotNull())
        .groupBy(mine, "ahead").agg(F.count("*").alias("n")).where("n > 1")
    )
    before = F.sum("n").over(W.partitionBy(mine).orderBy("ahead").rowsBetween(W.unboundedPreceding, -1))
    pairs = pairs.select(mine, "ahead", (F.col(mine) + F.coalesce(before, F.lit(0))).alias(out))
    return written(places.join(pairs, [mine, "ahead"], "left").drop("ahead"))


def _parts(places: DataFrame, min_words: int) -> DataFrame:
    """First and last place of the shortest parts of enough words, from and to every place."""
    total = F.sum("words").over(W.partitionBy(*DOC).orderBy("seq"))
    sums = places.select(*DOC, "seq", "words", total.alias("upto"))
    start = F.col("upto") - F.col("words")

    def row(side: int, key: Column, asks: bool) -> Column:
        return F.struct(F.lit(side).alias("side"), key.alias("key"), F.lit(asks).alias("asks"))

    rows = sums.select(
        *DOC, "seq",
        F.explode(F.array(
            row(0, -F.col("upto"), False), row(0, -(start + min_words), True),
            row(1, start, False), row(1, F.col("upto") - min_words, True),
        )).alias("row"),
    ).select(*DOC, "seq", "row.*")
    order = W.partitionBy(*DOC, "side").orderBy("key", "asks", "seq")
    met = F.last(F.when(~F.col("asks"), F.col("seq")), True).over(
        order.rowsBetween(W.unboundedPreceding, 0)
    )
    found = rows.withColumn("met", met).where("asks AND met IS NOT NULL")
    return found.select(
        *DOC, F.least("seq", "met").alias("first"), F.greatest("seq", "met").alias("last")
    ).distinct()


def repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, words: Callable[[Column], Column] = native
) -> DataFrame:
    """(doc_id, version, lines): numbers, from 0, of the lines of each document that go."""
    places = written(_ranked(docs, words))
    depth, level = 1, 0
    while 2 * depth <= min_words:
        places = _doubled(places, depth, level)
        depth, level = 2 * depth, level + 1
    count = F.col("last") - F.col("first") + 1
    parts = _parts(places, min_words).withColumns(
        {"count": count, "level": F.length(F.bin(count)) - 1}
    ).where(F.col("level") <= level)
    ranks = F.array(*[f"rank{k}" for k in range(level + 1)])
    head = places.select(*DOC, F.col("seq").alias("first"), ranks.alias("heads"))
    tail = places.select(*DOC, F.col("seq").alias("second"), ranks.alias("tails"))
    named = (
        parts.withColumn("second", F.expr("last + 1 - shiftleft(1, level)"))
        .join(head, [*DOC, "first"])
        .join(tail, [*DOC, "second"])
        .select(
            *DOC, "first", "last", "count",
            F.element_at("heads", F.col("level") + 1).alias("head"),
            F.element_at("tails", F.col("level") + 1).alias("tail"),
        )
        .where("head IS NOT NULL AND tail IS NOT NULL")
    )
    named = written(named)
    place = F.struct(*DOC, "first")
    origin = (
        named.groupBy("count", "head", "tail")
        .agg(F.min(place).alias("origin"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    gone = (
        named.join(origin, ["count", "head", "tail"]).where(place > F.col("origin"))
        .select(*DOC, F.explode(F.sequence("first", "last")).alias("seq"))
        .distinct()
    )
    return (
        gone.join(places.select(*DOC, "seq", "line"), [*DOC, "seq"])
        .groupBy(*DOC)
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
    )


def line_dedup(
    docs: DataFrame, min_words: int = MIN_WORDS, words: Callable[[Column], Column] = native
) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, …), ``text`` without its repeated lines.

    Adds n_lines and n_deleted. The rest of a text stays as it is, with its blank lines; a text
    of which nothing repeats is unchanged, a null text has no lines. Rows that repeat doc_id and
    text are one document and get the same result; a null doc_id comes first. An earlier column
    n_lines or n_deleted is replaced.
    """
    gone = repeated_lines(docs, min_words, words).withColumnRenamed("lines", "_gone")
    keyed = _keyed(docs.drop("n_lines", "n_deleted").withColumnsRenamed(
        {c: f"_{c}" for c in docs.columns if c in (*DOC, "_gone")}
    ))
    joined = keyed.join(gone, DOC, "left")
    rest = F.filter(_lines(F.col("text")), lambda _, i: ~F.array_contains(F.col("_gone"), i))
    joined = joined.select(
        *[F.col(f"_{c}" if c in (*DOC, "_gone") else c).alias(c) for c in docs.columns
          if c not in ("text", "n_lines", "n_deleted")],
        F.when(F.col("_gone").isNull(), F.col("text"))
        .otherwise(F.array_join(rest, "\n")).alias("text"),
        F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_deleted"),
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return joined.select(*kept, "n_lines", "n_deleted")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs`` after ``line_dedup``; documents of which nothing is left go.

    Where a text has changed, n_chars is its new length.
    """
    found = line_dedup(docs.drop("n_lines", "n_deleted"), min_words)
    left = found.where("n_deleted = 0 OR trim(replace(text, '\n', ' ')) <> ''")
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return left.select([c for c in docs.columns if c in left.columns])
