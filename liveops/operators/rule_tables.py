r"""Rule tables of any length over any number of texts, without an expression for each rule.

A table has the columns ``rule`` (bigint, distinct: the order of the rules), ``pattern``,
``level`` (or null), ``props`` (a map, or null) and ``mode`` (of ``props``). A pattern that
matches holds certain literal characters, also such with a gap between words (``foo[^A-Za-z]+bar``,
``foo\s+bar``). One n-gram of their UTF-8 bytes is the rule's key, the n-grams of the texts are read by tasks, and an equality join gives the rules that a text can match;
only those are tried. A bitmap of the keys, of bounded size, spares the join most n-grams that are
no key; once rules fill it, more of them reach the join, which alone decides.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from liveops.functions.maps import MODES, update
from liveops.operators.rules import Rule

#: Lengths of the n-grams in bytes, longest first, at most 7: of literals, and of runs in which what
#: is between letters counts as one sign. Patterns without a run as long as the last are loose.
GRAMS, GAPPED = (6, 4, 3), (7, 5, 4)
#: A gap in a run, a gap in a text, and the letters.
GAP, GAP_BYTE, LETTERS = "\uffff", np.uint8(ord("#")), string.ascii_letters
IS_LETTER = np.isin(np.arange(256), list(LETTERS.encode()))
#: The place of an n-gram's kind, its length, and what is added for one with gaps.
KIND, SPANNING = 56, 8
#: Bits of the bitmap as a power of 2; it is sent with one row of ``EVERY`` (a power of 2).
BITS, EVERY = 21, 1024
#: Bits of one bitmap of Spark as a power of 2, a fixed value; bytes of texts read at a time.
BLOCK, SLICE = 15, 1 << 17
SCHEMA = "rule bigint, pattern string, level bigint, props map<string,string>, mode string"


def table(spark, rules: list[Rule]) -> DataFrame:
    """A list of rules as a table."""
    rows = [(i, r.pattern, r.level, r.props or None, r.mode) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, SCHEMA)


def _class_end(pattern: str, at: int) -> int:
    """Place after the class that opens at ``at``; -1 for classes in classes and open ones."""
    at += 1
    at += pattern[at : at + 1] == "^"
    first = at
    while at < len(pattern):
        c = pattern[at]
        if c == "]" and at > first:
            return at + 1
        if c in "[&":
            return -1
        at += 2 if c == "\\" else 1
    return -1


def _gap(body: str) -> bool:
    """Whether a class of this body holds no letter of A-Z and a-z."""
    negated = body.startswith("^")
    if not re.fullmatch(r"(?:[A-Za-z0-9]-[A-Za-z0-9]|[ _.,:;/@0-9])+", body[negated:]):
        return False
    ranges = re.findall(r"[A-Za-z0-9]-[A-Za-z0-9]", body)
    return {"A-Z", "a-z"} <= set(ranges) if negated else not re.search("[A-Za-z]", body)


def literals(pattern: str | None) -> list[list[str]] | None:
    """Of each alternative outside of groups the runs that a match holds; None if none can be told.

    Groups, classes and what a quantifier can leave out end a run, so a part may be missed but is
    never wrong. ``GAP`` in a run stands for one or more signs that are no letters of A-Z and a-z.
    """
    if pattern is None or GAP in pattern or "\ufffd" in pattern:
        return None  # the second sign also stands for bytes that are no UTF-8
    found, runs, run, at, depth = [], [], "", 0, 0
    while at < len(pattern):
        c, escaped = pattern[at], pattern[at + 1 : at + 2]
        run, before = "", run
        if c == "[":
            end = _class_end(pattern, at)
            if end < 0:
                return None
            if not depth and _gap(pattern[at + 1 : end - 1]):
                run = before + GAP
            else:
                runs.append(before)
            at = end
            continue
        if c == "\\":
            if escaped.isdigit() or escaped in "QxuNpPkc":
                return None  # a quotation, a code or a name follows
            if escaped in "sWd" and not depth:
                run = before + GAP
            elif escaped.isalnum():
                runs.append(before)
            elif not depth:
                run = before + escaped
            at += 1
        elif c == "(":
            runs.append(before)
            if escaped == "?" and pattern[at + 2 : at + 3] not in (":", "=", "!", "<", ">"):
                return None  # flags change what the rest means
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth:
            pass
        elif c == "|":
            found.append([*runs, before])
            runs = []
        elif c in "*?{":
            runs.append(before[:-1])
            if c == "{":
                at = max(at, pattern.find("}", at))
        elif c == "+" and before and before[-1] not in LETTERS:
            run = before[:-1] + GAP
        elif c in ".^$+":
            runs.append(before)
        else:
            run = before + c
        at += 1
    return [*found, [*runs, run]]


def _longest(runs: list[str]) -> str:
    return max((part for run in runs for part in run.split(GAP)), key=len, default="")


def required(pattern: str | None) -> list[str] | None:
    """Literals of which every text that matches holds one, the longest of each alternative.

    None if one of them is too short for an n-gram or cannot be told.
    """
    longest = [_longest(runs) for runs in literals(pattern) or [[]]]
    return longest if min(map(len, longest)) >= GRAMS[-1] else None


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of bytes as numbers."""
    if n == 1:
        return data.astype(np.uint64)
    left = 4 if n > 4 else n // 2 + n % 2
    head, tail = _grams(data, left), _grams(data, n - left)[left:]
    return (head[: len(tail)] << np.uint64(8 * (n - left))) | tail


def _keyed(data: np.ndarray, n: int, spanning: bool) -> np.ndarray:
    """The n-grams with their kind above them."""
    return _grams(data, n) | np.uint64((n + SPANNING * spanning) << KIND)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def keys(pattern: str | None) -> list[list[int]] | None:
    """Of each alternative n-grams that all its matches hold; None where one of them has none.

    They are cut from the longest literal, or, where this is longer, from a run whose signs
    between letters count as one gap; of these only n-grams that hold a gap.
    """
    out = []
    for runs in literals(pattern) or [[]]:
        literal = _bytes(_longest(runs))
        gapped = [_bytes(re.sub("[^A-Za-z]+", "#", run)) for run in runs]
        data = max((x for x in gapped if ord("#") in x[1:-1]), key=len, default=literal)
        spanning = len(data) > len(literal) and len(data) >= GAPPED[-1]
        if not spanning:
            data = literal
        sizes = [n for n in (GAPPED if spanning else GRAMS) if n <= len(data)]
        if not sizes:
            return None
        found = _keyed(data, sizes[0], spanning)
        if spanning:
            within = np.lib.stride_tricks.sliding_window_view(data == ord("#"), sizes[0])
            found = found[within.any(axis=1)]
        out.append(np.unique(found).tolist())
    return out


def _place(grams: np.ndarray) -> np.ndarray:
    """Bits of n-grams in the bitmap."""
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _keys(patterns: pd.Series) -> pd.Series:
    return patterns.map(keys)


@F.pandas_udf(LongType())
def _bit(grams: pd.Series) -> pd.Series:
    return pd.Series(_place(grams.to_numpy(np.uint64)).astype(np.int64))


def _index(rules: DataFrame) -> DataFrame:
    """(gram, rule): of each alternative the n-gram that the fewest rules have."""
    needles = rules.select("rule", F.posexplode(_keys("pattern")).alias("branch", "grams"))
    rows = needles.select("rule", "branch", F.explode("grams").alias("gram"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("gram"))
    return (
        rows.withColumn("_n", shared)
        .groupBy("rule", "branch").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"))
        .select("gram", "rule").distinct()
    )


def _bitmap(index: DataFrame) -> Column:
    """The bits of all keys in blocks, a scalar subquery of ``2 ** BITS`` bits at most."""
    bits = index.select(_bit("gram").alias("_bit"), F.shiftright("gram", KIND).alias("_kind"))
    blocks = bits.groupBy(F.shiftright("_bit", BLOCK).alias("block")).agg(
        F.bitmap_construct_agg(F.col("_bit").bitwiseAND((1 << BLOCK) - 1)).alias("bits"),
        F.collect_set("_kind").alias("kinds"),
    )
    return blocks.agg(F.collect_list(F.struct("block", "bits", "kinds"))).scalar()


def _unpacked(blocks: list[dict]) -> tuple[np.ndarray, set[int]]:
    """The bits of all keys, and the kinds of n-grams among them."""
    out = np.zeros((1 << (BITS - BLOCK), 1 << BLOCK), np.bool_)
    for block in blocks:
        out[block["block"]] = np.unpackbits(np.frombuffer(block["bits"], np.uint8), bitorder="little")
    return out.ravel(), {kind for block in blocks for kind in block["kinds"]}


def _spanned(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with one sign for each run of bytes that are no letters, and their places in ``data``.

    Runs end where a text starts.
    """
    gap = ~IS_LETTER[data]
    kept = np.ones(len(data), np.bool_)
    kept[1:] = ~(gap[1:] & gap[:-1])
    kept[starts] = True
    at = np.flatnonzero(kept)
    return np.where(gap[at], GAP_BYTE, data[at]), at


def _met(texts: pa.Array, known: np.ndarray, kinds: set[int]):
    """Rows of ``texts`` and n-grams of ``kinds`` in them whose bit is ``known``, by pieces of bytes."""
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1] or not kinds:
        return
    data = np.frombuffer(data, np.uint8)[: ends[-1]]

    def found(signs, at, n, spanning):
        grams = _keyed(signs, n, spanning)
        i = np.flatnonzero(known[_place(grams)])
        row = np.searchsorted(ends, at[i], "right") - 1
        inside = at[i + n - 1] < ends[row + 1]
        return row[inside], grams[i][inside]

    more = max(GRAMS + GAPPED) - 1
    tail, tail_at = np.empty(0, np.uint8), np.empty(0, np.int64)
    for begin in range(int(ends[0]), len(data), SLICE):
        piece = data[begin : begin + SLICE + more]
        at = np.arange(begin, begin + len(piece))
        pairs = [found(piece, at, n, False) for n in GRAMS if n in kinds]
        # A gap can be longer than a piece, so the last signs are taken along.
        piece = piece[:SLICE]
        low, high = np.searchsorted(ends, [begin, begin + len(piece)])
        signs, at = _spanned(piece, ends[low:high] - begin)
        if len(tail) and tail[-1] == GAP_BYTE == signs[0] and ends[low] != begin:
            signs, at = signs[1:], at[1:]
        signs, at = np.concatenate([tail, signs]), np.concatenate([tail_at, at + begin])
        pairs += [found(signs, at, n, True) for n in GAPPED if n + SPANNING in kinds]
        tail, tail_at = signs[-more:], at[-more:]
        row, gram = map(np.concatenate, zip(*pairs))
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(row), np.bool_)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        yield row[new], gram[new].astype(np.int64)


def _likely(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(``_row``, rule) where a text holds a key of the rule."""
    # The first row of each partition has the bitmap, and some later ones.
    first = F.monotonically_increasing_id().bitwiseAND(EVERY - 1) == 0
    rows = texts.select("_row", "_text", F.when(first, _bitmap(index)).alias("_known"))
    schema = StructType([rows.schema["_row"]]).add("gram", LongType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        # All n-grams of all kinds until the bitmap comes.
        bits = np.ones(1 << BITS, np.bool_), {*GRAMS, *(n + SPANNING for n in GAPPED)}
        sent = False
        for batch in batches:
            ids, values, blocks = (batch.column(name) for name in ("_row", "_text", "_known"))
            if not sent and blocks.null_count < len(blocks):
                bits, sent = _unpacked(blocks.drop_null()[0].as_py()), True
            for row, grams in _met(values, *bits):
                if len(row):
                    columns = [ids.take(pa.array(row)), pa.array(grams)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema).join(index, "gram").select("_row", "rule").distinct()


def matches(df: DataFrame, rules: DataFrame, key: str, ids) -> DataFrame:
    """(``_row``, rule, level, props, mode) for each rule whose pattern is found in ``key``.

    ``_row`` is the struct of ``ids``, columns that make the rows of ``df`` distinct. Null texts and null patterns
    match nothing; a pattern that is no regular expression fails, as ``rlike`` does. Loose
    patterns are tried on every text: they are one array, which grows with their number alone.
    """
    # As one struct, in which nulls are equal.
    texts = df.select(F.struct(*ids).alias("_row"), F.col(key).alias("_text"))
    texts = texts.where(F.col("_text").isNotNull())
    rules = rules.select("rule", "pattern", "level", "props", "mode").where("pattern IS NOT NULL")
    likely = _likely(texts, _index(rules))
    tried = likely.join(rules, "rule").join(texts, "_row")
    found = tried.where(F.expr("rlike(_text, pattern)"))
    rule = F.struct("rule", "pattern", "level", "props", "mode")
    loose = rules.where(_keys("pattern").isNull()).agg(F.collect_list(rule)).scalar()
    hits = F.filter("_loose", lambda r: F.rlike(F.col("_text"), r["pattern"]))
    every = texts.withColumn("_loose", loose).select("_row", F.explode(hits).alias("_rule"))
    columns = ["rule", "level", "props", "mode"]
    return found.select("_row", *columns).unionByName(
        every.select("_row", *[F.col(f"_rule.{c}").alias(c) for c in columns])
    )


def apply(df: DataFrame, rules: DataFrame, key: str, ids, level: str = "level",
          props: str | None = None) -> DataFrame:
    """``rules.apply`` for a table of rules: in order where they match ``key``.

    ``ids`` are columns that make rows distinct. Rows that no rule matches stay as they are;
    the rules that match one row are held together, at most the whole table of rules.
    """
    hit = F.struct("rule", "props", "mode")
    hits = matches(df, rules, key, ids).groupBy("_row").agg(
        F.max_by("level", F.when(F.col("level").isNotNull(), F.col("rule"))).alias("_level"),
        F.array_sort(
            F.collect_list(F.when(F.col("props").isNotNull(), hit)),
            lambda a, b: F.signum(a["rule"] - b["rule"]).cast("int"),
        ).alias("_hits"),
    )
    out = df.join(hits, F.struct(*ids) == F.col("_row"), "left")
    changed = {level: F.coalesce("_level", F.col(level))}
    if props:
        def step(now, r):
            new = update(now, r["props"], MODES[-1])
            for mode in MODES[:-1]:
                new = F.when(r["mode"] == mode, update(now, r["props"], mode)).otherwise(new)
            return new

        folded = F.aggregate("_hits", F.col(props), step)
        changed[props] = F.when(F.col("_hits").isNotNull(), folded).otherwise(F.col(props))
    return out.withColumns(changed).drop("_row", "_level", "_hits")
