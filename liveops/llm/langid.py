"""Languages of words and texts with a linear-chain conditional random field.

Each word has features for its first and last one to four bytes, for its inner runs of two to
four bytes and for the whole word (a lexicon), hashed into one table of weights per label. Labels
of neighbouring words are tied by learned transitions. Texts are read whole: forward-backward
gives each word's probabilities, and a text's language is the one with the largest mean.

The field is fitted on the driver on a bounded sample: of each of at most ``LABELS`` languages
``DOCS`` labelled texts of least hash, and of each of them ``SPAN`` words from a hashed start. Texts of one
language never change label, so the sample is spliced into sequences of short spans from
different languages, from which the cost of a switch is learned. Prediction reads every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liveops.llm.words import CASED, Words, chunks, mix, split, text_bytes

#: The bounds of the training sample: texts of each language, words of each text, languages.
DOCS, SPAN, LABELS = 300, 120, 64
#: Ranges of hashes in which the texts of a language are looked for.
RANGES = 4096
#: Words whose probabilities are held at a time, and bytes of distinct words with their features.
PIECE, FEATURE_BYTES = 1 << 16, 1 << 18
BITS = 18
EPOCHS, RATE = 4, 0.3
#: Texts of the pipeline below this mean probability of their best language go.
LEAST = 0.3
UNKNOWN = "und"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_KINDS = mix(np.arange(1, 32, dtype=np.uint64) * _ODD)


def _letters(words: pa.Array) -> np.ndarray:
    """Which of the distinct words hold a letter."""
    _, data = text_bytes(words)
    offsets, _ = text_bytes(words)
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    sums = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & ~pc.string_is_ascii(words).to_numpy(False)):
        out[i] = any(c.isalpha() for c in words[int(i)].as_py())
    return out


def _features(words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers of distinct words, kind by kind, and the word each belongs to, in order."""
    offsets, data = text_bytes(words)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(words)), sizes)
    start, end = offsets[:-1][owner], offsets[1:][owner]
    at = np.arange(len(data))
    wide = data.astype(np.uint64) + np.uint64(1)
    shift = np.uint64(64 - BITS)
    out = []
    gram = np.zeros(len(data), np.uint64)
    for n in range(1, 5):
        # The run of n bytes that ends at each place.
        gram = wide if n == 1 else np.concatenate(([np.uint64(0)], gram[:-1])) << np.uint64(9) | wide
        full = at - start >= n - 1
        for kind, mask in (
            (n, full & (at - start == n - 1)), (4 + n, full & (at == end - 1)), (8 + n, full & (n > 1)),
        ):
            numbers = ((gram[mask] ^ _KINDS[kind]) * _ODD >> shift).astype(np.int64)
            out.append((numbers, owner[mask]))
    spread = mix(wide + _KINDS[20] * (at - start + 1).astype(np.uint64))
    whole = np.zeros(len(words), np.uint64)
    filled = sizes > 0
    if filled.any():
        whole[filled] = np.add.reduceat(spread, offsets[:-1][filled])
    numbers = (mix(whole + _KINDS[21]) >> shift).astype(np.int64)
    out.append((numbers, np.arange(len(words))))
    return [(numbers, owners) for numbers, owners in out if len(numbers)]


def _worded(texts: pa.Array) -> tuple[Words, pa.Array]:
    """Words with a letter, as codes of the distinct words, and these in lower case."""
    words = split(texts, CASED)
    kept = _letters(words.words)
    if not kept.all():
        full = kept[words.codes]
        sums = np.concatenate(([0], np.cumsum(full)))
        words = Words(sums[words.offsets], words.codes[full], words.words)
    lower = pc.utf8_lower(words.words).dictionary_encode()
    return Words(words.offsets, lower.indices.to_numpy()[words.codes], lower.dictionary), lower.dictionary


class Field:
    """Weights of a fitted field; small enough to travel with each task."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weights = np.zeros((1 << BITS, k), np.float32)
        self.transition = np.zeros((k, k))
        self.start = np.zeros(k)

    def scores(self, words: pa.Array) -> np.ndarray:
        """The score of each label for each distinct word."""
        out = np.zeros((len(words), len(self.labels)))
        ends = np.cumsum(pc.binary_length(words).to_numpy(False), dtype=np.int64)
        start = 0
        while start < len(words):
            # Features of some words at a time: a dozen for each byte.
            upto = (ends[start - 1] if start else 0) + FEATURE_BYTES
            stop = max(start + 1, int(np.searchsorted(ends, upto, "right")))
            self._score(words.slice(start, stop - start), out[start:stop])
            start = stop
        return out

    def _score(self, words: pa.Array, out: np.ndarray) -> None:
        for numbers, owners in _features(words):
            values = self.weights[numbers]
            heads = np.flatnonzero(np.diff(owners, prepend=-1))
            if len(heads) < len(owners):
                values = np.add.reduceat(values, heads, axis=0)
            out[owners[heads]] += values

    def steps(self, scores: np.ndarray, first: np.ndarray) -> _Steps:
        return _Steps(self, scores, first)

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of words in one row, and those given only what stands before.

        ``first`` marks the first word of each text.
        """
        return self.steps(scores, first).marginals()

    def chances(self, scores: np.ndarray, codes: np.ndarray, starts: np.ndarray):
        """Label probabilities of a row of words, in pieces: (place of the first word, matrix).

        ``scores`` are those of the distinct words, ``starts`` the first words of texts. Whole
        texts go together up to ``PIECE`` words. A longer text is cut: the product of each piece
        is taken first, and what it hands on in either direction makes the pieces exact.
        """
        first = np.zeros(len(codes), bool)
        first[starts] = True
        ends = np.append(starts[1:], len(codes))
        a = 0
        while a < len(codes):
            within = int(np.searchsorted(ends, a + PIECE, "right"))
            b = int(ends[within - 1]) if within and ends[within - 1] > a else a
            if b > a:
                yield a, self.marginals(scores[codes[a:b]], first[a:b])[0]
                a = b
                continue
            b = int(ends[within])
            cuts = [(c, min(c + PIECE, b)) for c in range(a, b, PIECE)]
            products = [self.steps(scores[codes[c:d]], first[c:d]).product() for c, d in cuts]
            k = len(self.labels)
            ahead, behind = [np.full(k, 1 / k)], [np.full(k, 1 / k)]
            for product in products[:-1]:
                ahead.append(_share(ahead[-1] @ product))
            for product in products[:0:-1]:
                behind.append(_share(product @ behind[-1]))
            for (c, d), before, after in zip(cuts, ahead, behind[::-1], strict=True):
                yield c, self.steps(scores[codes[c:d]], first[c:d]).marginals(before, after)[0]
            a = b


def _share(x: np.ndarray) -> np.ndarray:
    return x / x.sum()


class _Steps:
    """Forward-backward over words in one row, exact and run in parallel.

    The row is cut into blocks that lie side by side; the product of the steps of each block is
    taken for all blocks at once, and these are chained. At the first word of a text a step
    forgets what came before. Only the last block can be shorter: it ends before the others.
    """

    def __init__(self, field: Field, scores: np.ndarray, first: np.ndarray):
        self.total, self.k = total, k = scores.shape
        self.length = length = max(1, int(np.sqrt(total)))
        self.blocks = blocks = -(-total // length)
        emit = np.ones((blocks * length, k))
        emit[:total] = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -50))
        self.emit = np.ascontiguousarray(emit.reshape(blocks, length, k).transpose(1, 0, 2))
        fresh = np.zeros(blocks * length, bool)
        fresh[:total] = first
        self.fresh = [np.flatnonzero(row) for row in fresh.reshape(blocks, length).T]
        filled = total - (blocks - 1) * length
        self.live = [blocks if i < filled else blocks - 1 for i in range(length)]
        self.move = np.exp(field.transition - field.transition.max())
        self.begin = np.exp(field.start - field.start.max())

    def products(self) -> np.ndarray:
        """The product of the steps of each block, up to a factor."""
        k = self.k
        out = np.tile(np.eye(k), (self.blocks, 1, 1))
        for i, (n, fresh) in enumerate(zip(self.live, self.fresh, strict=True)):
            moved = (out[:n].reshape(-1, k) @ self.move).reshape(n, k, k)
            if len(fresh):
                moved[fresh] = out[fresh].sum(2)[:, :, None] * self.begin
            out[:n] = moved * self.emit[i][:n, None, :]
            if i % 6 == 5 or i == self.length - 1:
                out /= out.sum((1, 2), keepdims=True)
        return out

    def product(self) -> np.ndarray:
        """The product of all steps, up to a factor."""
        out = np.eye(self.k)
        for one in self.products():
            out = out @ one
            out /= out.sum()
        return out

    def marginals(self, before=None, after=None) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities, and those given only what stands before.

        ``before`` and ``after`` weigh the labels at either end, if the row is part of a text.
        """
        blocks, k, emit, move = self.blocks, self.k, self.emit, self.move
        product = self.products()
        ahead, behind = np.empty((blocks, k)), np.empty((blocks, k))
        vector = np.full(k, 1 / k) if before is None else before
        for b in range(blocks):
            ahead[b] = vector
            vector = _share(vector @ product[b])
        vector = np.full(k, 1 / k) if after is None else after
        for b in range(blocks - 1, -1, -1):
            behind[b] = vector
            vector = _share(product[b] @ vector)
        del product
        forward, both = np.zeros((2, self.length, blocks, k))
        state = ahead
        for i, (n, fresh) in enumerate(zip(self.live, self.fresh, strict=True)):
            moved = state[:n] @ move
            if len(fresh):
                moved[fresh] = state[fresh].sum(1)[:, None] * self.begin
            moved *= emit[i][:n]
            state[:n] = moved / moved.sum(1, keepdims=True)
            forward[i] = state
        state = behind
        for i in range(self.length - 1, -1, -1):
            n, fresh = self.live[i], self.fresh[i]
            both[i, :n] = forward[i, :n] * state[:n]
            seen = state[:n] * emit[i][:n]
            moved = seen @ move.T
            if len(fresh):
                moved[fresh] = (seen[fresh] @ self.begin)[:, None]
            state[:n] = moved / moved.sum(1, keepdims=True)
        forward, both = (x.transpose(1, 0, 2).reshape(-1, k)[: self.total] for x in (forward, both))
        both /= both.sum(1, keepdims=True)
        return both, forward


def _fit(field: Field, sequences: list[tuple[np.ndarray, np.ndarray]], numbers, starts) -> None:
    """Gradient ascent with a rate per weight on the likelihood of ``sequences`` (codes, labels)."""
    k = len(field.labels)
    rng = np.random.default_rng(5)
    squares = np.full(field.weights.shape, 1e-6, np.float32)
    move2, start2 = np.full((k, k), 1e-6), np.full(k, 1e-6)
    ends = np.append(starts[1:], len(numbers))
    batch = 64
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for low in range(0, len(order), batch):
            part = [sequences[i] for i in order[low : low + batch]]
            codes = np.concatenate([c for c, _ in part])
            labels = np.concatenate([y for _, y in part])
            first = np.zeros(len(codes), bool)
            first[np.cumsum([0] + [len(c) for c, _ in part[:-1]])] = True
            distinct, back = np.unique(codes, return_inverse=True)
            sizes = ends[distinct] - starts[distinct]
            flat = np.concatenate([numbers[starts[d] : ends[d]] for d in distinct])
            heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            scores = np.add.reduceat(field.weights[flat], heads, axis=0)[back].astype(np.float64)
            chance, before = field.marginals(scores, first)
            error = -chance
            error[np.arange(len(labels)), labels] += 1
            per_word = np.zeros((len(distinct), k))
            np.add.at(per_word, back, error)
            spread = np.repeat(per_word, sizes, axis=0)
            used, place = np.unique(flat, return_inverse=True)
            slope = np.stack([np.bincount(place, spread[:, j], len(used)) for j in range(k)], 1)
            slope = (slope / len(codes) * 50).astype(np.float32)
            squares[used] += slope**2
            field.weights[used] += RATE * slope / np.sqrt(squares[used])
            inner = np.flatnonzero(~first)
            seen = np.zeros((k, k))
            np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
            # The probability of a pair of neighbours: what leads to the second, given it.
            pair = before[inner - 1][:, :, None] * np.exp(field.transition)
            pair = pair / pair.sum(1, keepdims=True) * chance[inner][:, None, :]
            slope = (seen - pair.sum(0)) / len(codes) * 50
            move2 += slope**2
            field.transition += RATE / 2 * slope / np.sqrt(move2)
            slope = (np.bincount(labels[first], minlength=k) - chance[first].sum(0)) / first.sum()
            start2 += slope**2
            field.start += RATE / 2 * slope / np.sqrt(start2)


def sample(docs: DataFrame) -> DataFrame:
    """The bounded training sample: lang, text and hash of ``DOCS`` texts of each language.

    Of more than ``LABELS`` languages those with the most rows are learned (ties by name). Texts
    are found by least hash, first in ``RANGES`` ranges of hashes, where rows combine before the
    shuffle, then among the ranges: no task sees more than ``RANGES`` rows of a language.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", "text", F.xxhash64("text").alias("hash")
    )
    learned = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS)
    least = (
        known.groupBy("lang", F.pmod("hash", F.lit(RANGES)).alias("range"))
        .agg(F.min(F.xxhash64("hash")).alias("order"), F.min_by("hash", F.xxhash64("hash")).alias("hash"))
        .withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("order")))
        .where(F.col("n") <= DOCS)
    )
    # At most ``LABELS`` languages, and ``DOCS`` hashes of each.
    chosen = least.join(F.broadcast(learned.select("lang")), "lang", "left_semi").select("lang", "hash")
    return known.join(F.broadcast(chosen), ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``SPAN`` words of each sampled text from a start taken from its hash."""
    for batch in chunks(batches):
        out = []
        words, lower = _worded(batch.column("text"))
        for d, key in enumerate(batch.column("hash").to_pylist()):
            codes = words.codes[words.offsets[d] : words.offsets[d + 1]]
            at = key % max(1, len(codes) - SPAN)
            out.append(lower.take(pa.array(codes[at : at + SPAN])).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("hash"), pa.array(out, pa.list_(pa.string()))],
            names=["lang", "hash", "words"],
        )


def fit(docs: DataFrame) -> Field:
    """A field fitted on the bounded sample of the labelled rows of ``docs`` (text, lang)."""
    spans = sample(docs).mapInArrow(_spans, "lang string, hash long, words array<string>")
    rows = {(r.lang, r.hash): r.words for r in spans.collect() if r.words}
    labels = sorted({lang for lang, _ in rows})
    field = Field(labels)
    if not labels:
        return field
    coded = pa.array([w for _, ws in sorted(rows.items()) for w in ws]).dictionary_encode()
    codes, rng = coded.indices.to_numpy(), np.random.default_rng(3)
    lengths = {key: len(words) for key, words in sorted(rows.items())}
    del rows
    pieces, at = [], 0
    for (lang, _), length in lengths.items():
        mine = codes[at : at + length]
        at += length
        cut = 0
        while cut < len(mine):
            n = int(rng.integers(4, 40))
            pieces.append((mine[cut : cut + n], labels.index(lang)))
            cut += n
    order = rng.permutation(len(pieces))
    sequences = []
    for low in range(0, len(order), 4):
        part = [pieces[i] for i in order[low : low + 4]]
        sequences.append((
            np.concatenate([c for c, _ in part]), np.concatenate([np.full(len(c), y) for c, y in part]),
        ))
    numbers, owners = (np.concatenate(x) for x in zip(*_features(coded.dictionary), strict=True))
    order = np.argsort(owners, kind="stable")
    numbers, owners = numbers[order].astype(np.int32), owners[order]
    starts = np.searchsorted(owners, np.arange(len(coded.dictionary)))
    _fit(field, sequences, numbers, starts)
    return field


def _chances(field: Field, words: Words, lower: pa.Array):
    starts = words.offsets[:-1][words.counts > 0]
    return field.chances(field.scores(lower), words.codes, starts)


def _predicted(field: Field, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if field.labels:
        words, lower = _worded(texts)
        full = np.flatnonzero(words.counts)
        starts, sums = words.offsets[:-1][full], np.zeros((len(full), len(field.labels)))
        for a, chance in _chances(field, words, lower):
            # Texts with words in this piece; the first may have begun in one before.
            low = int(np.searchsorted(starts, a, "right")) - 1
            high = int(np.searchsorted(starts, a + len(chance)))
            sums[low:high] += np.add.reduceat(chance, np.maximum(starts[low:high], a) - a, axis=0)
        mean = sums / words.counts[full][:, None]
        if len(full):
            # Sums of other neighbours in a piece differ in the last digits.
            best[full] = np.clip(mean.max(1), 0, 1).round(9)
            for d, j in zip(full, mean.argmax(1), strict=True):
                names[d] = field.labels[j]
    return names, best


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text).

    lang_pred is ``und`` and score 0 for a null text, one without a letter, or if nothing was
    learned. Otherwise score is the mean probability of lang_pred over the words with a letter,
    to nine digits; ties go to the first label by name. Rows that repeat are each predicted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            names, best = _predicted(field, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names), pa.array(best)],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def word_labels(texts: list[str | None], field: Field) -> list[list[str]]:
    """The likeliest label of each word with a letter, for a few texts at hand."""
    words, lower = _worded(pa.array(texts, pa.string()))
    named = [field.labels[j] for _, chance in _chances(field, words, lower) for j in chance.argmax(1)]
    return [named[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]


def held_out(column: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` with a field fitted on the rows of ``docs`` that are not held out."""
    return predict(docs, fit(docs.where(~held_out())))


def in_a_language(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages, all columns.

    Rows without text or letters go, and those whose best language has a mean probability below
    ``least``. With nothing learned all rows stay. Filtered where they are read, without a shuffle.
    """
    field = fit(docs.where(~held_out()))
    if not field.labels:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            names, best = _predicted(field, batch.column("text"))
            kept = [name != UNKNOWN and p >= least for name, p in zip(names, best, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
