"""Benchmark questions in documents, also with other numbers, names and units put in.

Words are canonicalised: a number, a unit and a name become typed placeholders, other words are
lower-cased without punctuation at their ends. What a word may be depends on the word alone: one
with a capital, unless it is in ``FUNCTION``, is read both as a name and as a plain word, and a
template window is made for every combination of readings. Windows of ``SIZE`` words of benchmark
items, as they stand and as templates, are joined by equality with those of documents. Before the
join documents drop windows whose hash is not in a bit map of the benchmark's windows; its size is
fixed (``MAP_BITS``), and a false hit only costs a row.

A window with all its capitals read as names that has fewer than half of ``SIZE`` literal words is
widened, from its start to the right and from its end to the left, until it has. Items shorter
than ``SIZE`` are one window, with at least half and at least two literal words; an item without so
many, or a longer one without half of ``SIZE`` in all, is found by its own words only.

Hits of one document and item on one alignment agree when each value of the item stands for one
value of the document. Where they do not all agree, agreeing hits are gathered outwards from every
hit, and the set that covers most words counts: no less than the longest stretch of hits that
agree, and no less than the words as they stand. A document is reported when agreeing hits cover
``COVER`` words of an item, or all of a shorter one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.llm.words import CASED, chunks, hash_words, mix, split, windows
from liveops.session import written

SIZE = 8
COVER = 13
#: A template window holds at least this part of its size, and two, of words that are no placeholders.
LITERAL = 0.5
MAP_BITS = 24
#: So many readings of windows are held at once.
READINGS = 1 << 18
#: Bytes of text that are cut into windows at once: some twenty numbers a word.
CHUNK = 2 << 20
#: The factor between places of a window in its hash.
_STEP = 0x9E3779B97F4A7C15


def _least(size: int) -> int:
    """Literal words of a template window of ``size`` words."""
    return max(2, math.ceil(LITERAL * size))

#: Units.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "ounce", "ounces",
    "pound", "pounds", "lb", "lbs", "oz", "ml", "l", "litre", "litres", "liter", "liters",
    "gallon", "gallons", "cup", "cups", "second", "seconds", "minute", "minutes", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar",
    "dollars", "euro", "euros", "percent", "degrees", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "kilometre", "kilometres", "centimeters", "kmh", "mph",
)
#: Words that are no names when a capital opens them.
FUNCTION = (
    "a", "an", "the", "this", "that", "these", "those", "he", "she", "it", "we", "you", "they",
    "his", "her", "its", "our", "your", "their", "my", "what", "which", "who", "whom", "whose",
    "when", "where", "why", "how", "if", "then", "and", "or", "but", "so", "because", "while",
    "after", "before", "in", "on", "at", "by", "for", "from", "to", "of", "with", "as", "into",
    "is", "are", "was", "were", "be", "do", "does", "did", "has", "have", "had", "there", "not",
    "each", "every", "all", "some", "no",
)
PLAIN, NUMBER, UNIT, NAME = range(4)
SLOTS = np.array(["", "<number>", "<unit>", "<name>"], object)
#: Punctuation that separates words; full stops and commas may stand in numbers.
_BREAKS = CASED.copy()
_BREAKS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,!?'"]] = 32


class _Canon:
    """Canonical words of a chunk of texts."""

    def __init__(self, texts: pa.Array):
        words = split(texts, _BREAKS)
        raw = pc.ascii_trim(words.words, ".,!?'")
        core = pc.utf8_lower(raw)
        kind = np.zeros(len(raw), np.int8)
        capital = pc.utf8_is_upper(pc.utf8_slice_codeunits(raw, 0, 1))
        capital = pc.and_not(capital, pc.is_in(core, pa.array(FUNCTION)))
        kind[capital.to_numpy(False)] = NAME
        kind[pc.is_in(core, pa.array(UNITS)).to_numpy(False)] = UNIT
        kind[pc.match_substring_regex(core, "^[0-9][0-9.,]*$").to_numpy(False)] = NUMBER
        real = pc.binary_length(core).to_numpy(False) > 0
        codes, offsets = words.codes, words.offsets
        if not real.all():
            full = real[codes]
            sums = np.concatenate(([0], np.cumsum(full)))
            offsets, codes = sums[offsets], codes[full]
        self.codes, self.offsets, self.core = codes, offsets, core
        self.kind = kind[codes]
        self.plain = hash_words(core)[codes]
        self.slot = mix(np.arange(1, 5, dtype=np.uint64))

    def exact(self, size: int) -> tuple[np.ndarray, ...]:
        """Hashes, places, sizes and readings (no slot) of the windows as they stand."""
        hashes, places = windows(self.plain, self.offsets, size)
        return hashes, places, np.full(len(places), size), np.zeros(len(places), np.int64)

    def wide(self, size: int) -> tuple[np.ndarray, ...]:
        """Dense windows of ``size`` words, widened; all capitals are read as names (-1)."""
        literal = np.flatnonzero(self.kind == PLAIN)
        before = np.concatenate(([0], np.cumsum(self.kind == PLAIN)))
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        starts = np.repeat(self.offsets[:-1], np.diff(self.offsets))
        at = np.arange(max(0, len(self.kind) - size + 1))
        least = _least(size)
        at = at[(at + size <= ends[at]) & (before[at + size] - before[at] < least)]
        right = at[before[at] + least <= len(literal)]
        stop = literal[before[right] + least - 1] + 1
        inside = stop <= ends[right]
        left = at[before[at + size] >= least]
        start = literal[before[left + size] - least]
        within = start >= starts[left]
        place = np.concatenate((right[inside], start[within]))
        sizes = np.concatenate((stop[inside], left[within] + size)) - place
        # A prefix sum of hash times power, moved to the window's place by the inverse power.
        n = len(self.kind)
        power, back = np.full(n, _STEP, np.uint64), np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
        power[:1] = back[:1] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        hashes = np.where(self.kind == PLAIN, self.plain, self.slot[self.kind])
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64)))
        total = (sums[place + sizes] - sums[place]) * back[place]
        # Apart from the windows of one size.
        return mix(total + mix(sizes.astype(np.uint64))), place, sizes, np.full(len(place), -1)

    def templates(self, size: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Hashes, places, sizes and readings (a bit for each place read as a name) of all templates.

        A template has a slot and enough other words.
        """
        n = len(self.plain) - size + 1
        if n <= 0:
            return
        names = self.kind == NAME
        fixed = (self.kind == NUMBER) | (self.kind == UNIT)
        hashes = np.where(fixed, self.slot[self.kind], self.plain)
        delta = self.slot[NAME] - self.plain
        power = np.array([pow(_STEP, size - 1 - k, 1 << 64) for k in range(size)], np.uint64)
        totals, used, open_ = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(size):
            totals += hashes[k : k + n] * power[k]
            used += fixed[k : k + n]
            open_ += names[k : k + n]
        most = size - _least(size)
        inside = np.arange(n) + size <= np.repeat(self.offsets[1:], np.diff(self.offsets))[:n]
        starts = np.flatnonzero(inside & (used <= most) & (used + open_ > 0))
        ends = np.cumsum(1 << open_[starts])
        first = 0
        while first < len(starts):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + READINGS, "right")))
            at = starts[first:last]
            total, slots, read = totals[at], used[at], np.zeros(len(at), np.int64)
            for k in range(size):
                on = np.flatnonzero(names[at + k] & (slots < most))
                total = np.concatenate((total, total[on] + delta[at[on] + k] * power[k]))
                slots = np.concatenate((slots, slots[on] + 1))
                read = np.concatenate((read, read[on] | 1 << k))
                at = np.concatenate((at, at[on]))
            full = slots > 0
            yield mix(total[full]), at[full], np.full(full.sum(), size), read[full]
            first = last

    def rows(self, places: np.ndarray, sizes: np.ndarray, read: np.ndarray, template: bool):
        """The windows at ``places`` as text, their words, and which of these may be slots."""
        out = []
        for at, size, names in zip(places, sizes, read.tolist(), strict=True):
            words = self.core.take(pa.array(self.codes[at : at + size])).to_pylist()
            kinds = self.kind[at : at + size].tolist()
            shown = [
                SLOTS[k] if k in (NUMBER, UNIT) or k == NAME and names >> i & 1 else w
                for i, (w, k) in enumerate(zip(words, kinds, strict=True))
            ] if template else words
            out.append((" ".join(shown), words, [k != PLAIN for k in kinds]))
        return out


_SCHEMA = (
    "id long, place int, size int, template boolean, window string, words array<string>, slots array<boolean>, "
    "hash long"
)


def _emitted(ids, owner, places, sizes, read, template, canon: _Canon, hashes) -> pa.RecordBatch:
    rows = canon.rows(places, sizes, read, template)
    first = canon.offsets[owner]
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(owner)), pa.array((places - first).astype(np.int32)),
            pa.array(sizes.astype(np.int32)), pa.array([template] * len(places), pa.bool_()),
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.list_(pa.string())),
            pa.array([r[2] for r in rows], pa.list_(pa.bool_())), pa.array(hashes.view(np.int64)),
        ],
        names=["id", "place", "size", "template", "window", "words", "slots", "hash"],
    )


def _windows(texts: pa.Array, ids: pa.Array, sizes: list[int], whole: int, bits: np.ndarray | None):
    """All windows of ``sizes`` words; those of ``whole`` words also widened."""
    canon = _Canon(texts)
    for size in sizes:
        # Each is cut when its turn comes, and held until the next.
        cut = chain(
            ((False, canon.exact(n)) for n in [size]),
            ((True, t) for t in canon.templates(size)),
            ((True, canon.wide(n)) for n in [size] if n == whole),
        )
        for template, (hashes, places, lengths, read) in cut:
            if bits is not None:
                spot = hashes >> np.uint64(64 - MAP_BITS)
                kept = (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                hashes, places, lengths, read = hashes[kept], places[kept], lengths[kept], read[kept]
            if len(places):
                owner = np.searchsorted(canon.offsets, places, "right") - 1
                yield _emitted(ids, owner, places, lengths, read, template, canon, hashes)


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """All windows of the items (item_id, text); of shorter items the whole item is the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            counts = np.diff(_Canon(batch.column("text")).offsets)
            for n in np.unique(np.minimum(counts, size)):
                if n:
                    mine = batch.filter(pa.array(np.minimum(counts, size) == n))
                    yield from _windows(mine.column("text"), mine.column("item_id"), [int(n)], size, None)

    return items.select("item_id", "text").where("item_id IS NOT NULL").mapInArrow(run, _SCHEMA)


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """The bit map of the first ``MAP_BITS`` bits of the hashes: ``2 ** (MAP_BITS - 3)`` bytes."""
    spot = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    bytes_ = hashes.groupBy(F.shiftright(spot, 3).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) % 8 as int))")).alias("bits")
    ).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bits[bytes_.column("at").to_numpy()] = bytes_.column("bits").to_numpy().astype(np.uint8)
    return bits


_PAIRS = pa.list_(pa.struct([("in_item", pa.string()), ("in_doc", pa.string())]))


def _settled(hits: list[dict]) -> tuple[set[int], bool, list[dict]]:
    """The words that agreeing hits of an alignment cover, whether as they stand, differing slots."""
    found, values = [], {}
    own: set[int] = set()
    for hit in hits:
        words = range(hit["at"], hit["at"] + hit["size"])
        if hit["own"]:
            own.update(words)
        pairs = {(p["in_item"], p["in_doc"]) for p in hit["pairs"]}
        for mine, theirs in pairs:
            values.setdefault(mine, set()).add(theirs)
        found.append((words, pairs))
    clash = {mine for mine, theirs in values.items() if len(theirs) > 1}
    # Hits that say the same of the clashing values stand or fall together at one place.
    marked = {(words.start, words.stop, frozenset(p for p in pairs if p[0] in clash)) for words, pairs in found}
    # A hit that gives one value two others agrees with nothing, itself included.
    marked = sorted(
        (m for m in marked if len({mine for mine, _ in m[2]}) == len(m[2])), key=lambda m: (m[0], m[1], sorted(m[2]))
    )
    best: set[int] = set()
    chosen: dict[str, str] = {}
    for seed in marked if clash else marked[:1]:
        names: dict[str, str] = {}
        covered: set[int] = set()
        middle = seed[0] + seed[1]
        for start, stop, pairs in sorted(marked, key=lambda m: (m is not seed, abs(m[0] + m[1] - middle))):
            if all(names.get(mine, theirs) == theirs for mine, theirs in pairs):
                names.update(pairs)
                covered.update(range(start, stop))
        if len(covered) > len(best):
            best, chosen = covered, names
    if len(own) >= len(best):
        return own, True, []
    slots = {
        p for words, pairs in found for p in pairs
        if p[0] != p[1] and best.issuperset(words) and all(chosen.get(q[0], q[1]) == q[1] for q in pairs)
    }
    return best, False, [{"in_item": a, "in_doc": b} for a, b in sorted(slots)]


def find(docs: DataFrame, items: DataFrame, size: int = SIZE, cover: int = COVER) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, covered, item_words, exact, slots.

    covered and item_words count words of the item; exact tells that all covered words are the
    item's own; slots are the pairs (in_item, in_doc) that differ. Null and empty texts hold
    nothing, null ids take no part, and rows that repeat count once.
    """
    theirs = written(item_windows(items, size))
    sizes = sorted(r["size"] for r in theirs.where(F.col("size") <= size).select("size").distinct().collect())
    counts = theirs.groupBy("id").agg((F.max(F.col("place") + F.col("size"))).alias("item_words"))
    bits = _bit_map(theirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            yield from _windows(batch.column("text"), batch.column("doc_id"), sizes, size, bits)

    ours = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, _SCHEMA)
    theirs = theirs.select(
        F.col("id").alias("item_id"), F.col("place").alias("at"), "size", "template", "window",
        F.col("words").alias("item_text"), F.col("slots").alias("item_slots"),
    ).distinct()
    pair = F.arrays_zip(
        F.col("item_text").alias("in_item"), F.col("words").alias("in_doc"), F.col("item_slots").alias("slot")
    )
    hits = ours.join(theirs, ["window", "size", "template"]).select(
        F.col("id").alias("doc_id"), "item_id", (F.col("place") - F.col("at")).alias("shift"),
        "at", "size", "template",
        F.transform(
            F.filter(pair, lambda p: p["slot"]),
            lambda p: F.struct(p["in_item"].alias("in_item"), p["in_doc"].alias("in_doc")),
        ).alias("pairs"),
    )
    aligned = hits.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set(F.struct("at", "size", (~F.col("template")).alias("own"), "pairs")).alias("hits")
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_settled(batch.column("hits")[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "item_id", "shift")),
                    pa.array([len(words) for words, _, _ in out], pa.int32()),
                    pa.array([exact for _, exact, _ in out], pa.bool_()),
                    pa.array([slots for _, _, slots in out], _PAIRS),
                ],
                names=["doc_id", "item_id", "shift", "covered", "exact", "slots"],
            )

    best = (
        aligned.mapInArrow(
            settle, "doc_id long, item_id long, shift int, covered int, exact boolean, "
            "slots array<struct<in_item:string,in_doc:string>>"
        )
        .select("doc_id", "item_id", F.struct(
            "covered", (-F.col("shift")).alias("place"), "slots", "exact"
        ).alias("best"))
        .groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
        .join(counts.select(F.col("id").alias("item_id"), "item_words"), "item_id")
    )
    return best.where(F.col("best.covered") >= F.least(F.lit(cover), "item_words")).select(
        "doc_id", "item_id", "best.covered", "item_words", "best.exact", "best.slots"
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, all columns."""
    found = find(docs, items).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
