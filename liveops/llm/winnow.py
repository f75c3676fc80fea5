"""Document fingerprints by winnowing, with DataFrame functions only.

Every run of ``GRAM`` code points of a text has a hash. Of each window of ``WINDOW`` neighbouring
hashes the least is chosen, the rightmost of equal ones, and kept with its position (the code
points before it). So any passage of ``GRAM + WINDOW - 1`` code points that two texts share
leaves a hash that both fingerprints hold, at its place in each, and no passage shorter than
``GRAM`` does.

Hashes and positions stand in one number, the hash above and the distance from the end below:
the least number is the rightmost of the least hashes. Minima of windows come from doubling, each
round the smaller of two neighbouring minima of half the width. Texts are read in blocks of
``BLOCK`` windows that overlap by a window, so arrays are bounded and long texts take time in
proportion to their length; what two blocks choose alike at their seam is kept once.

``edited`` needs each document's successor by doc_id. Rows are cut into parts of like size by
splitters over (doc_id, hash of the text); the first row of a part is a splitter itself and is
copied to the part before, so successors come from one shuffle of the texts and no wider window.
The edited text is spliced from two, and so is its fingerprint: each text is hashed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liveops.operators.numbered import part_count, place, splitters
from liveops.session import written

#: Code points of a hashed run, and hashes of a window (a power of two).
GRAM, WINDOW = 12, 32
#: Windows of a block. A position in a block has ``_PLACE`` bits, a hash the rest of a number.
BLOCK = 1 << 16
_PLACE = 17
_MOST = (1 << _PLACE) - 1
HASH_BITS = 63 - _PLACE


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbers(block: Column, gram: int) -> Column:
    """Hash and position of every run of a block; a shorter block is one run."""
    runs = F.when(F.length(block) < gram, F.array(block)).otherwise(
        # The dot moves on by a code point; the look-ahead holds the run that starts there.
        F.regexp_extract_all(block, F.lit(rf"(?s)(?=(.{{{gram}}}))."), F.lit(1))
    )
    high = F.lit(((1 << HASH_BITS) - 1) << _PLACE)
    return F.transform(runs, lambda run, i: F.xxhash64(run).bitwiseAND(high) + (F.lit(_MOST) - i))


def _chosen(block: Column, gram: int, window: int) -> Column:
    """The numbers that some window of a block chooses, by position."""

    def least(numbers: Column, width: int) -> Column:
        if width == window:
            full = F.size(numbers) - (window - 1)
            return F.array_distinct(F.slice(numbers, F.lit(1), full))
        wider = F.zip_with(
            numbers, F.slice(numbers, F.lit(width + 1), F.size(numbers)), lambda a, b: F.least(a, b)
        )
        return _let(wider, lambda x: least(x, 2 * width))

    return _let(_numbers(block, gram), lambda numbers: F.when(
        F.size(numbers) < window, F.array(F.array_min(numbers))
    ).otherwise(least(numbers, 1)))


def _placed(numbers: Column, before: Column) -> Column:
    return F.transform(numbers, lambda x: F.struct(
        F.shiftright(x, _PLACE).alias("hash"),
        (before + (F.lit(_MOST) - x.bitwiseAND(F.lit(_MOST)))).cast("long").alias("position"),
    ))


def _joined(parts: Column) -> Column:
    """The fingerprints of stretches that follow each other; what two choose alike is kept once."""
    return _let(F.flatten(parts), lambda found: F.filter(
        found, lambda x, i: (i == 0) | (F.get(found, i - 1)["position"] != x["position"])
    ))


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> Column:
    """The fingerprint of a text: an array of (hash, position), by position.

    An empty text has none. A text of fewer than ``gram`` code points is one run, one with fewer
    runs than ``window`` is one window. A null text gives null.
    """
    if window < 1 or window & (window - 1) or block + window > 1 << _PLACE:
        raise ValueError("window must be a power of two, and block and window fit a position")
    reach = gram + window - 2
    blocks = F.regexp_extract_all(
        text, F.lit(rf"(?s)(?=(.{{1,{block + reach}}})).{{1,{block}}}"), F.lit(1)
    )
    # Past the first block, what is shorter than a window was seen whole by the block before.
    each = F.transform(blocks, lambda part, b: F.when(
        (b == 0) | (F.length(part) > reach),
        _placed(_chosen(part, gram, window), b.cast("long") * block),
    ).otherwise(F.array()))
    return F.when(F.length(text) <= block + reach, F.when(
        F.length(text) > 0, _placed(_chosen(text, gram, window), F.lit(0).cast("long"))
    ).otherwise(F.array())).otherwise(_joined(each))


def _head(found: Column, size: Column, window: int, reach: int) -> Column:
    """What the windows inside the first ``size`` code points of a text choose, from its ``found``.

    Choices never go back as windows go on, and the choice of a window is the least hash that the
    fingerprint holds inside it. So these are all up to the choice of the last such window.
    """
    last = size - reach - 1
    inside = F.filter(found, lambda x: (x["position"] >= last) & (x["position"] < last + window))
    least = F.array_min(F.transform(inside, lambda x: F.struct(x["hash"], (-x["position"]).alias("at"))))
    upto = _let(least, lambda x: F.filter(found, lambda y: y["position"] <= -x["at"]))
    return F.when(last >= 0, upto).otherwise(F.array())


def spliced(
    text: Column, found: Column, other: Column, other_found: Column, head: Column, tail: Column,
    gram: int = GRAM, window: int = WINDOW,
) -> Column:
    """The fingerprint of the first ``head`` code points of a text, then ``tail`` of an other one.

    It comes from both fingerprints: only windows that stand across the seam are hashed anew.
    ``head`` and ``tail`` are at most the lengths of the texts.
    """
    reach = gram + window - 2
    before, after = F.least(head, F.lit(reach)), F.least(tail, F.lit(reach))
    across = F.concat(text.substr(head - before + 1, before), other.substr(F.lit(1), after))
    start = (head - before).cast("long")
    moved = F.transform(_head(other_found, tail, window, reach), lambda x: F.struct(
        x["hash"].alias("hash"), (x["position"] + head).alias("position")
    ))
    return F.when(
        # Too short for a window, all of it is across the seam.
        head + tail <= reach, fingerprint(across, gram, window)
    ).otherwise(_joined(F.array(
        _head(found, head, window, reach),
        F.when(F.length(across) > reach, _placed(_chosen(across, gram, window), start)).otherwise(F.array()),
        moved,
    )))


def hashes(found: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(found, lambda x: x["hash"]))


def shown(found: Column) -> Column:
    """A fingerprint as text: ``hash:position`` in hexadecimal and decimal digits, by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.lower(F.hex(x["hash"])), x["position"].cast("string")
    )), ",")


def likeness(a: Column, b: Column) -> Column:
    """Common share of two sets of hashes (intersection by union); 1 if both are empty."""
    def share(common: Column) -> Column:
        union = F.size(a) + F.size(b) - common
        return F.when(union == 0, F.lit(1.0)).otherwise(common / union)

    return _let(F.size(F.array_intersect(a, b)), share)


def followed(rows: DataFrame, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """``rows`` with the added ``columns`` and ``next_…`` of the row after it, the last row's first.

    ``columns`` are computed after the shuffle, once a row. Rows equal in ``order`` must be equal
    in what is read from the next one.
    """
    keys = written(rows.select(*order))
    parts = part_count(rows)
    key = F.struct(*order)
    first = keys.agg(F.min(key)).scalar()
    cut = rows.withColumn("_cuts", splitters(keys, order, parts)).withColumn("_first", key == first)
    cut = cut.withColumn("_part", place(order, parts))

    def goes(part: Column, again: bool) -> Column:
        return F.struct(part.cast("int").alias("_in"), F.lit(again).alias("_copy"))

    targets = F.array(
        goes(F.col("_part"), False),
        # A part starts with its splitter; the first row of all follows the last.
        F.when(F.get("_cuts", F.col("_part") - 1) == key, goes(F.col("_part") - 1, True)),
        F.when(F.col("_first"), goes(F.greatest(F.size("_cuts"), F.lit(0)), True)),
    )
    dealt = cut.withColumn("_to", F.explode(F.array_compact(targets))).select(*rows.columns, "_to.*")
    # Once dealt out, the columns are computed where the window below finds them.
    dealt = dealt.repartition("_in").withColumns(columns)
    window = W.partitionBy("_in").orderBy("_copy", *order)
    after = {f"next_{c}": F.lead(c).over(window) for c in ("text", *columns)}
    return dealt.withColumns(after).where("NOT _copy").drop("_in", "_copy")


def edited(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text.

    The edited text has the last half of its code points (rounded down) replaced by as many first
    ones, or all, of the next document by doc_id, and after the last of the first. Adds
    edited_text, found and edited_found (arrays of hash and position), and near_edited and
    near_next, the likeness to the edited text's and the next document's fingerprint. A null text
    is empty. A null doc_id comes first; rows of one doc_id follow each other by a hash of the
    text, and rows that repeat both are each a document. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    found = followed(rows, ["doc_id", "version"], {"found": fingerprint(F.col("text"), gram, window)})
    half = F.floor(F.length("text") / 2).cast("int")
    sized = found.withColumns({
        "_head": F.length("text") - half, "_tail": F.least(half, F.length("next_text")),
    })
    text, other = F.col("text"), F.col("next_text")
    both = sized.withColumns({
        "edited_text": F.concat(text.substr(F.lit(1), F.col("_head")), other.substr(F.lit(1), F.col("_tail"))),
        "edited_found": spliced(
            text, F.col("found"), other, F.col("next_found"), F.col("_head"), F.col("_tail"), gram, window
        ),
    })
    near = both.withColumns({
        "_own": hashes(F.col("found")), "_edited": hashes(F.col("edited_found")),
        "_next": hashes(F.col("next_found")),
    })
    return near.select(
        "doc_id", "text", "edited_text", "found", "edited_found",
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
