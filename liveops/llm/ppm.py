"""Code length of documents under prediction by partial matching, with a smoothed word model.

The model is a trie of byte contexts of up to ``ORDER`` bytes over lower-cased texts (A-Z), each
started by ``ORDER`` and ended by one byte 0xFF, which UTF-8 never holds. A byte is coded in the
longest context seen; in a context with total T and D distinct successors (without those excluded)
a successor has n / (T + D) and the escape D / (T + D), after which the successors of the longer
context are excluded from the shorter one. Below order 0 the bytes left are equally likely.

With pretrained counts a byte's probability depends on the ``ORDER`` bytes before it, so a text's
code length is a sum over its distinct windows of ``ORDER + 1`` bytes. The counts grow with the
corpus and are never broadcast: documents are dealt into chunks of bounded size, each chunk asks
for the distinct windows and words it holds, in one array per bucket of keys; a bucket answers all
chunks at once. A trie node of order 2 has all its longer contexts in one group (256^3 windows at
most); only the counts of orders 1 and 0 (65,536 numbers) travel with the tasks.

The words of the base model are counted the same way, by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.llm.words import PLAIN, hash_words, split, text_bytes
from liveops.session import written

ORDER = 4
CHUNK_BYTES = 5 << 20
EDGE = 255
SMOOTH = 0.1
#: The key of the token that ends a text.
END = np.uint64(0x9E3779B97F4A7C15)
WORD, WINDOW = 0, 1

_REQUEST = "kind int, chunk int, bucket int, keys array<long>, counts array<long>"


def byte_windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows that end at each byte and at the end of each text, and text offsets."""
    offsets, data = text_bytes(texts.fill_null(""))
    sizes = np.diff(offsets).astype(np.int64)
    heads = np.concatenate(([0], np.cumsum(sizes + ORDER + 1)))
    flat = np.full(int(heads[-1]), EDGE, np.uint8)
    place = np.arange(len(data)) + np.repeat(heads[:-1] + ORDER - offsets[:-1], sizes)
    flat[place] = PLAIN[data]
    key = np.zeros(len(flat), np.int64)
    for k in range(ORDER, -1, -1):
        # The byte k places before.
        key[k:] |= flat[: len(flat) - k].astype(np.int64) << (8 * k)
    coded = np.ones(len(flat), bool)
    for k in range(ORDER):
        coded[heads[:-1] + k] = False
    return key[coded], np.concatenate(([0], np.cumsum(sizes + 1)))


def _word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of distinct words, the word number of each token, and text offsets."""
    words = split(texts)
    return hash_words(words.words).view(np.int64), words.codes, words.offsets


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    spread = keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return ((spread >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _asked(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which distinct rising ``keys`` are asked for, and the bounds of buckets in it."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _counted(train: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of both, rising, and how often each stands in ``train``."""
    keys, counts = np.unique(train, return_counts=True)
    other = np.setdiff1d(np.unique(held), keys, assume_unique=True)
    both = np.concatenate([keys, other])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([counts, np.zeros(len(other), np.int64)])[order]


def _chunk_keys(texts: pa.Array, held: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and training counts of a chunk: its words, then its windows."""
    keys, codes, offsets = _word_keys(texts)
    owner = np.repeat(held, np.diff(offsets))
    in_train = np.bincount(codes[~owner], minlength=len(keys)).astype(np.int64)
    keys = np.append(keys, END.view(np.int64))
    in_train = np.append(in_train, (~held).sum())
    order = np.argsort(keys, kind="stable")
    windows, offsets = byte_windows(texts)
    owner = np.repeat(held, np.diff(offsets))
    return [(keys[order], in_train[order]), _counted(windows[~owner], windows[owner])]


def _lists(values: list[np.ndarray], kind=np.int64) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind, copy=False)))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the bounds of rows."""
    sizes = [np.diff(c.offsets.to_numpy()) for c in column.chunks]
    values = [c.flatten().to_numpy() for c in column.chunks]
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, int)
    return np.concatenate(values) if values else np.zeros(0, np.int64), bounds


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and the place of each key among them."""
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, counts)
    return distinct, total, place


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return n / np.maximum(total, 1)


def trie_costs(keys: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 probability of the windows of one order-2 context, given all of that context.

    ``n`` counts each window in training (0: only asked for); ``low[c, s]`` counts byte s after c.
    """
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)

    def code(count, total, distinct) -> None:
        """Codes the open windows with a count, and escapes with the others."""
        nonlocal open_
        whole = np.broadcast_to(total + distinct, keys.shape).astype(float)
        hit = open_ & (count > 0)
        out[hit] += np.log10(np.broadcast_to(count, keys.shape)[hit] / whole[hit])
        open_ = open_ & ~hit
        miss = open_ & (whole > 0)
        out[miss] += np.log10(np.broadcast_to(distinct, keys.shape)[miss] / whole[miss])

    def context(symbol_keys, counts):
        """Number of each key's context, and the totals and distinct successors of contexts."""
        _, place = np.unique(symbol_keys >> 8, return_inverse=True)
        return place, np.bincount(place, counts), np.bincount(place, counts > 0)

    def seen_above(place, above, counts):
        """Counts, summed by longer context, of the successors that it has too."""
        return np.bincount(place, np.where(above > 0, counts, 0))

    keys3, at3 = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
    n3 = np.bincount(at3, n)
    keys2, at2 = np.unique(keys3 & 0xFFFFFF, return_inverse=True)
    n2 = np.bincount(at2, n3)
    n1 = low[int(keys[0] >> 8) & 255].astype(float)
    n0 = low.sum(0).astype(float)
    symbol = (keys & 255).astype(np.int64)

    c4, total4, distinct4 = context(keys, n)
    code(n, total4[c4], distinct4[c4])
    c3, total3, distinct3 = context(keys3, n3)
    code(n3[at3], total3[c3][at3] - seen_above(c4, n, n3[at3])[c4], distinct3[c3][at3] - distinct4[c4])
    excluded = seen_above(c3, n3, n2[at2])[c3][at3]
    code(n2[at2][at3], n2.sum() - excluded, (n2 > 0).sum() - distinct3[c3][at3])
    after2 = np.zeros(256)
    after2[keys2 & 255] = n2
    code(n1[symbol], n1.sum() - n1[after2 > 0].sum(), (n1 > 0).sum() - (after2 > 0).sum())
    code(n0[symbol], n0.sum() - n0[n1 > 0].sum(), (n0 > 0).sum() - (n1 > 0).sum())
    out[open_] -= np.log10(256 - (n0 > 0).sum())
    return out


class _Lookup:
    """Values of keys that are known to be in a rising list, faster than by halving."""

    BITS = 22

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.slots = np.zeros(1 << self.BITS, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        lost = np.flatnonzero(self.keys[at] != keys)
        at[lost] = np.searchsorted(self.keys, keys[lost])
        return self.values[at]


def score(docs: DataFrame, held) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` by doc_id.

    ``held`` is a column: rows for which it is true are scored but not learned from. base_score is
    the word model's, score the trie's log10 probability. Null and empty texts are their end alone.
    Each row is a text of its own, also if rows repeat or the doc_id is null.
    """
    rows = docs.select("doc_id", "text", held.alias("held"))
    # Bytes of UTF-8; one pass that reads lengths alone.
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ORDER + 1)).first()[0] or 0
    chunks = max(1, -(-int(total) // CHUNK_BYTES))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        kinds, buckets, keys, counts = [], [], [], []
        parts = _chunk_keys(table.column("text").combine_chunks(), table.column("held").to_numpy())
        for kind, (mine, n) in enumerate(parts):
            order, bounds = _asked(mine, chunks)
            for b in np.flatnonzero(np.diff(bounds)):
                part = order[bounds[b] : bounds[b + 1]]
                kinds.append(kind)
                buckets.append(b)
                keys.append(mine[part])
                counts.append(n[part])
        return pa.table({
            "kind": pa.array(kinds, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(kinds), pa.int32()),
            "bucket": pa.array(buckets, pa.int32()), "keys": _lists(keys), "counts": _lists(counts),
        })

    asked = written(dealt.groupBy("chunk").applyInArrow(ask, _REQUEST))
    words, windows = asked.where(F.col("kind") == WORD), asked.where(F.col("kind") == WINDOW)

    def count(table: pa.Table) -> pa.Table:
        """Answers each chunk with its words' counts; chunk -1 gets the bucket's total and number."""
        keys, bounds = _flat(table.column("keys"))
        _, total, place = _sums(keys, _flat(table.column("counts"))[0])
        answers = [total[place[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        answers.append(np.array([total.sum(), (total > 0).sum()]))
        bucket = table.column("bucket")[0].as_py()
        return pa.table({
            "kind": pa.array([WORD] * len(answers), pa.int32()),
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int32()),
            "bucket": pa.array([bucket] * len(answers), pa.int32()), "values": _lists(answers, np.float64),
        })

    answer = "kind int, chunk int, bucket int, values array<double>"
    of_words = written(words.groupBy("bucket").applyInArrow(count, answer))
    sums = of_words.where("chunk < 0").agg(
        F.sum(F.element_at("values", 1)).alias("n"), F.sum(F.element_at("values", 2)).alias("v")
    ).first()
    train_tokens, distinct = int(sums["n"] or 0), int(sums["v"] or 0)

    def add(table: pa.Table) -> pa.Table:
        distinct, total, _ = _sums(_flat(table.column("keys"))[0], _flat(table.column("counts"))[0])
        return pa.table({"key": distinct, "n": total})

    trie = written(windows.groupBy("bucket").applyInArrow(add, "key long, n long"))
    low = np.zeros((256, 256), np.int64)
    pair = F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("pair")
    for r in trie.groupBy(pair).agg(F.sum("n").alias("n")).collect():
        low[r["pair"] >> 8, r["pair"] & 255] = r["n"]

    def cost(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        costs = trie_costs(keys, table.column("n").to_numpy(), low)
        return pa.table({"key": keys, "cost": costs, "home": pa.array(_bucket(keys, chunks).astype(np.int32))})

    costs = (
        trie.withColumn("context", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
        .groupBy("context").applyInArrow(cost, "key long, cost double, home int")
    )

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, bounds = _flat(left.column("keys"))
        known = right.column("key").to_numpy()
        order = np.argsort(known)
        values = right.column("cost").to_numpy()[order][np.searchsorted(known[order], keys)] if len(keys) else keys
        answers = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({
            "kind": pa.array([WINDOW] * len(answers), pa.int32()),
            "chunk": left.column("chunk"), "bucket": left.column("bucket"), "values": _lists(answers, np.float64),
        })

    of_windows = windows.select("chunk", "bucket", "keys").groupBy("bucket").cogroup(
        costs.groupBy("home")
    ).applyInArrow(reply, answer)
    answers = of_words.where("chunk >= 0").union(of_windows).withColumnRenamed("chunk", "to")
    scale = np.log10(train_tokens + SMOOTH * (distinct + 1))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, held_ = left.column("text").combine_chunks(), left.column("held").to_numpy()
        parts = _chunk_keys(texts, held_)
        found = []
        for kind, (mine, _) in enumerate(parts):
            order, bounds = _asked(mine, chunks)
            values = np.zeros(len(mine))
            rows = right.filter(pc.equal(right.column("kind"), kind))
            flat, ends = _flat(rows.column("values"))
            for i, b in enumerate(rows.column("bucket").to_pylist()):
                values[order[bounds[b] : bounds[b + 1]]] = flat[ends[i] : ends[i + 1]]
            found.append(_Lookup(mine, values))
        keys, codes, offsets = _word_keys(texts)
        count_ = found[WORD](np.append(keys, END.view(np.int64)))
        prob = np.log10(count_ + SMOOTH) - scale
        sums = lambda x: np.concatenate(([0], np.cumsum(x)))
        known, base = sums(count_[codes] > 0), sums(prob[codes])
        windows_, at = byte_windows(texts)
        total_ = sums(found[WINDOW](windows_))
        return pa.table({
            "doc_id": left.column("doc_id"),
            "n_tokens": np.diff(offsets) + 1,
            "n_known": known[offsets[1:]] - known[offsets[:-1]] + int(count_[-1] > 0),
            "base_score": base[offsets[1:]] - base[offsets[:-1]] + prob[-1],
            "score": total_[at[1:]] - total_[at[:-1]],
        })

    out = dealt.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(
        finish, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return out.withColumn("train_tokens", F.lit(train_tokens).cast("long"))
