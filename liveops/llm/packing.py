"""Documents packed into sequences of a fixed number of tokens by bin completion.

What is packed depends on lengths alone, and there are at most ``CAPACITY`` of them: the driver
gets the histogram of piece lengths and plans on it, whatever the number of documents. The plan
is a list of (filling, how often); each filling of a sequence is a multiset of lengths.

Planning is bin completion branch and bound. The largest length left opens a sequence; its
undominated fillings are enumerated (no length left over could take the place of one or two of
the filling's and use more of the room), least waste first, and a filling is used as often as
the histogram allows, or half as often, and so on. A branch is cut when the sequences used and the
least number that the rest can need (total length over capacity) reach the best solution known.
Best fit decreasing gives the first solution; the search ends when the bound is met or after
``NODES`` nodes. Then a few sequences at a time are taken apart and searched again.

Places are dealt by rank: a piece's rank among those of its length is its rank in its input
partition plus the counts of partitions before, so no length is ever gathered in one task. The
plan's intervals of ranks are at most a few per length and filling and travel with the tasks.
"""

from __future__ import annotations

import random
import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liveops.llm.words import CASED, chunks, split, text_bytes
from liveops.session import written

CAPACITY = 2048
END = 0
#: Words whose ids a worker remembers between chunks; about 100 MB.
KNOWN_WORDS = 400_000
#: Bounds of the search, not of the result: nodes, fillings tried at a node, steps to find them.
NODES, WIDTH, STEPS = 3_000, 8, 120
#: Rounds of improvement, sequences with waste (and full ones) taken apart in one, and its nodes.
ROUNDS, APART, APART_NODES = 3_000, 8, 40
#: Pieces a length from which an eighth of the histogram is planned first.
MANY = 40


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Tokenizer:
    """Token ids of distinct words of a tokenizer that splits at white space and drops it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        # The visible characters that stand for bytes in byte-level vocabularies.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}

    def ids(self, word: str) -> list[int]:
        # Lower-case letters that are normal already are one piece, which the model takes as it is.
        if word.isalpha() and word == word.lower():
            if word.isascii():
                return [t.id for t in self.model.tokenize(word)]
            if unicodedata.is_normalized("NFC", word):
                shown = "".join([self.chars[b] for b in word.encode()])
                return [t.id for t in self.model.tokenize(shown)]
        return self.full.encode(word, add_special_tokens=False).ids


    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word as 32-bit numbers; words of chunks before are remembered, up to a bound."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, out = self.known, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = array("I", self.ids(word)).tobytes()
            out.append(ids)
        return out


_LOADED: dict[str, _Tokenizer] = {}


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one row, each text's closed by ``END``, and the offsets of texts."""
    if path not in _LOADED:
        _LOADED[path] = _Tokenizer(path)
    tokenizer = _LOADED[path]
    words = split(texts, CASED)
    raw = words.words
    # Distinct words are fewer in lower case and without a full stop or comma after a letter,
    # which is a piece of its own at the end of a word.
    lower = pc.if_else(pc.string_is_ascii(raw), pc.ascii_lower(raw), raw)
    stem = pc.replace_substring_regex(lower, "([a-z])[.,]$", "\\1")
    tail = np.zeros(len(raw), np.int64)
    cut = pc.not_equal(stem, lower).to_numpy(False)
    if cut.any():
        ends, data = text_bytes(lower)
        last = data[ends[1:][cut] - 1]
        marks = {m: tokenizer.ids(m)[0] + 1 for m in ".,"}
        tail[cut] = np.where(last == ord("."), marks["."], marks[","])
    coded = stem.dictionary_encode()
    each = tokenizer.encoded(coded.dictionary.to_pylist())
    sizes = np.array([len(x) for x in each], np.int64) // 4
    flat = np.frombuffer(b"".join(each), np.uint32)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else sizes
    stems = coded.indices.to_numpy()
    # The ids of one word after another, then a word's mark, then the end of a text.
    n_texts = len(words.offsets) - 1
    of = stems[words.codes]
    mark = tail[words.codes]
    lengths = sizes[of] + (mark > 0)
    upto = np.concatenate(([0], np.cumsum(lengths)))
    offsets = upto[words.offsets] + np.arange(n_texts + 1)
    out = np.full(int(offsets[-1]), END, np.uint32)
    begin = upto[:-1] + words.docs
    plain = sizes[of]
    total = int(plain.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(plain) - plain, plain)
    out[np.repeat(begin, plain) + inside] = flat[np.repeat(starts[of], plain) + inside]
    marked = mark > 0
    out[(begin + plain)[marked]] = (mark[marked] - 1).astype(np.uint32)
    return out, offsets


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and part and rank (see above)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(batches)
        # A worker lives on; what it remembers of words goes with its partition.
        if path in _LOADED:
            _LOADED[path].known.clear()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in chunks(batches):
            ids, offsets = token_ids(batch.column("text"), path)
            totals = np.diff(offsets)
            counts = -(-totals // capacity)
            owner = np.repeat(np.arange(len(totals)), counts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            length = np.minimum(capacity, totals[owner] - start)
            begin = offsets[owner] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin, length, strict=True)]
            # Rank within partition and length: equal lengths in a row, counted on.
            order = np.argsort(length, kind="stable")
            run_start = np.flatnonzero(np.diff(length[order], prepend=-1))
            sizes = np.diff(np.append(run_start, len(order)))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(run_start, sizes) + seen[length[order]]
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)),
                    pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(np.full(len(owner), part, np.int32)), pa.array(rank),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    )


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram; sequences filled alike are handled together."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, filling, n = capacity, (), left
            # The tightest sequence stays so until no more of this length fits.
            each = min(room // length, left)
            used = min(n, left // each)
            if filling and n > used:
                put(room, filling, n - used)
            put(room - each * length, filling + (length,) * each, used)
            left -= used * each
    return [group for groups in open_.values() for group in groups]


def _sums(counts: dict[int, int], lengths: list[int], room: int) -> int:
    """Bits of all sums up to ``room`` of the rising ``lengths``, each at most ``counts`` times."""
    mask, sums = (1 << (room + 1)) - 1, 1
    for x in lengths:
        for _ in range(min(counts[x], room // x)):
            sums |= sums << x & mask
    return sums


def _fillings(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from ``counts`` (``lengths``: their rising lengths).

    Least waste first; of equal waste those with the smallest second length, which pair large
    lengths with small ones and leave middling ones for each other. A length is tried only where
    the rest of the room is a sum of lengths, so hardly a step leads nowhere.
    """
    found: list[tuple[int, ...]] = []
    steps, sums = STEPS, _sums(counts, lengths, room)

    def grow(rest: int, at: int, filling: tuple[int, ...]) -> None:
        nonlocal steps
        if not rest:
            found.append(filling)
            return
        at = min(at, bisect_right(lengths, rest))
        while at and steps > 0 and len(found) < WIDTH:
            at -= 1
            x = lengths[at]
            if sums >> (rest - x) & 1 and counts[x] > filling.count(x):
                steps -= 1
                grow(rest - x, at + 1, (*filling, x))

    left, out = sums, []
    while left and len(out) < WIDTH and steps > 0:
        total = left.bit_length() - 1
        left ^= 1 << total
        found.clear()
        grow(total, len(lengths), ())
        waste = room - total
        for filling in sorted(found):
            smaller = set(filling) | {y + z for i, y in enumerate(filling) for z in filling[i + 1 :]}
            if not waste or not any(_between(counts, lengths, filling, y, y + waste) for y in smaller):
                out.append(filling)
    return out[:WIDTH] or [()]


def _between(counts, lengths, filling, low: int, high: int) -> bool:
    """Whether a length above ``low`` and up to ``high`` is left beside ``filling``."""
    at = bisect_right(lengths, low)
    while at < len(lengths) and lengths[at] <= high:
        if counts[lengths[at]] > filling.count(lengths[at]):
            return True
        at += 1
    return False


Plan = list[tuple[tuple[int, ...], int]]


def _search(counts: dict[int, int], capacity: int, fewest: int, bound: int, nodes: int) -> Plan | None:
    """The best plan of fewer than ``fewest`` sequences found by bin completion, if any.

    Depth first; a filling is used as often as the histogram allows, then, going back, half as
    often, and so on. Ends at ``bound`` sequences or after ``nodes`` nodes.
    """
    counts = {x: n for x, n in counts.items() if n}
    lengths, left = sorted(counts), sum(x * n for x, n in counts.items())
    used, chosen, best = 0, [], None

    def options() -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings of a sequence that the largest length left opens, and how often."""
        largest = lengths[-1]
        counts[largest] -= 1
        found = _fillings(counts, [x for x in lengths if counts[x]], capacity - largest)
        counts[largest] += 1
        often = [
            ((largest, *f), min(counts[x] // (f.count(x) + (x == largest)) for x in {largest, *f})) for f in found
        ]
        while often:
            yield from often
            often = [(f, n // 2) for f, n in often if n > 1]

    def use(filling: tuple[int, ...], n: int) -> None:
        nonlocal used, left
        for x in set(filling):
            was = counts[x]
            counts[x] -= n * filling.count(x)
            if not counts[x]:
                del lengths[bisect_left(lengths, x)]
            elif not was:
                insort(lengths, x)
        used, left = used + n, left - sum(filling) * n

    tries = [options()] if lengths else []
    while tries and fewest > bound and nodes:
        filling, n = next(tries[-1], (None, 0))
        if filling is None:
            tries.pop()
            if chosen:
                filling, n = chosen.pop()
                use(filling, -n)
            continue
        nodes -= 1
        if used + n + -(-(left - sum(filling) * n) // capacity) >= fewest:
            continue
        use(filling, n)
        if left:
            chosen.append((filling, n))
            tries.append(options())
        else:
            best, fewest = [*chosen, (filling, n)], used
            use(filling, -n)
    return best


def _count(planned: Plan) -> int:
    return sum(n for _, n in planned)


def _merged(*plans: Plan) -> Plan:
    groups: dict[tuple[int, ...], int] = {}
    for planned in plans:
        for filling, n in planned:
            key = tuple(sorted(filling, reverse=True))
            groups[key] = groups.get(key, 0) + n
    return list(groups.items())


def _lengths(planned) -> dict[int, int]:
    counts: dict[int, int] = {}
    for filling, n in planned:
        for x in filling:
            counts[x] = counts.get(x, 0) + n
    return counts


def _improved(planned: Plan, capacity: int, bound: int) -> Plan:
    """``planned`` with a few sequences at a time taken apart and completed anew.

    Each round takes sequences with waste and some full ones (every other round likelier those
    that stand often), searches them by bin completion, and keeps what needs fewer sequences or
    gathers the waste in fewer; alike sequences are all replaced at once. ``ROUNDS`` rounds.
    """
    rng, groups = random.Random(5), dict(_merged(planned))
    total = sum(groups.values())
    for i in range(ROUNDS):
        loose = [f for f in groups if sum(f) < capacity]
        full = [f for f in groups if sum(f) == capacity]
        if total <= bound or not loose:
            break
        weigh = i % 2
        pool = set(rng.choices(
            loose, [groups[f] * (capacity - sum(f)) if weigh else 1 for f in loose], k=rng.randint(2, APART)
        ))
        if full:
            pool |= set(rng.choices(full, [groups[f] if weigh else 1 for f in full], k=rng.randint(0, APART)))
        taken = [(f, 1) for f in sorted(pool)]
        counts = _lengths(taken)
        least = -(-sum(x * n for x, n in counts.items()) // capacity)
        got = _search(counts, capacity, len(taken) + 1, min(least, len(taken)), APART_NODES)
        if got is None:
            continue
        gain = len(taken) - _count(got)
        squares = sum(sum(f) ** 2 * n for f, n in got) - sum(sum(f) ** 2 for f in pool)
        if gain > 0 or not gain and squares > 0:
            copies = min(groups[f] for f in pool)
            for filling, n in [*((f, -1) for f in pool), *_merged(got)]:
                groups[filling] = groups.get(filling, 0) + n * copies
                if not groups[filling]:
                    del groups[filling]
            total -= gain * copies
    return list(groups.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """(filling, number of sequences) that use up ``histogram`` (length: how many).

    Best fit decreasing, unless it meets the bound; else bin completion, improved in parts. A
    histogram of many of each length is an eighth of it, planned so and used eight times, and
    the rest; both are improved together.
    """
    counts = {x: n for x, n in histogram.items() if n}
    best = _best_fit(counts, capacity)
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    if _count(best) <= bound:
        return best
    found = _search(counts, capacity, _count(best), bound, NODES) or best
    if sum(counts.values()) > MANY * len(counts):
        part = plan({x: n // 8 for x, n in counts.items()}, capacity)
        rest = plan({x: n % 8 for x, n in counts.items()}, capacity)
        found = min(found, _merged([(f, 8 * n) for f, n in part], rest), key=_count)
    return min(best, _improved(found, capacity, bound), key=_count)


#: Bits of a rank in a sort key below its length.
_RANK_BITS = 44


def _intervals(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (key of length and first rank, first sequence, copies in each, first offset)."""
    rows, taken, sequence = [], {}, 0
    for filling, n in planned:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            copies = filling.count(length)
            rank = taken.get(length, 0)
            rows.append(((length << _RANK_BITS) + rank, sequence, copies, offset))
            taken[length] = rank + n * copies
            offset += copies * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    Null and empty texts are the end id alone. Texts of more than ``capacity`` tokens are cut,
    others are whole. Each row is a document: rows that repeat are packed each, also with a null
    doc_id. Places in a sequence run from 0 without gaps; sequence_id from 0.
    """
    cut = written(pieces(docs, path, capacity))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = _intervals(plan(histogram, capacity))
    before = F.sum("n").over(
        W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    )
    counts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = (length << _RANK_BITS) + batch.column("rank").to_numpy()
            first, sequence, copies, offset = placed[np.searchsorted(placed[:, 0], key, "right") - 1].T
            step = key - first
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(sequence + step // copies), pa.array(offset + step % copies * length),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    ranked = cut.join(counts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select(*names, "rank").mapInArrow(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
