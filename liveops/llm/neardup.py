"""MinHash near-duplicates with tensored banding, links confirmed on whole shingle sets.

Two collections of ``SIDE`` short keys, each of two minhashes, are computed per text. A table
key combines one key of each collection, so ``2 * SIDE`` keys (``4 * SIDE`` minhashes) give
``SIDE ** 2`` tables of four minhashes. Two sets of similarity s share a key with probability
(1 - (1 - s^2)^SIDE)^2, which is 0.9999 at the threshold of 0.75.

Equal sets become one node first. A key no other node has cannot make a shared table key,
so only repeated ones are combined. In each bucket every node is compared with the bucket's
least node, which settles groups of copies in linear work. Of buckets that still hold several
components, likely pairs are those of different components whose sizes allow 0.75 and that agree
in at least ``AGREE`` of the 48 minhashes (true pairs miss that with probability below 0.0001).
They are never listed: a bucket yields a spanning forest of them, and the trees' nodes meet
with their whole sets in blocks of bounded size, which confirm links and yield a spanning forest
of those. So rows stay in proportion to nodes, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveops.llm.components import components
from liveops.llm.words import chunks, hash_words, mix, split, windows
from liveops.session import written

SHINGLE = 5
SIDE = 12
HASHES = 4 * SIDE
AGREE = 24
#: Nodes of a bucket, and shingles of sets, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20

_SEED = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_ODD = mix(_SEED) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of each text; of all words if fewer."""
    words = split(texts)
    hashes = hash_words(words.words)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    values, places = windows(hashes, words.offsets, SHINGLE)
    bounds = np.searchsorted(places, words.offsets)
    out = []
    for d, n in enumerate(words.counts):
        if n >= SHINGLE:
            out.append(np.unique(values[bounds[d] : bounds[d + 1]]))
        elif n:
            whole = hashes[words.offsets[d] : words.offsets[d + 1]]
            out.append(windows(whole, np.array([0, n]), int(n))[0] ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    """One list per row of a matrix of 64-bit numbers."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(rows.ravel())))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = shingle_sets(batch.column("text"))
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        least = np.zeros((len(sets), HASHES), np.uint32)
        ids = np.zeros((len(sets), 2), np.uint64)
        if len(full):
            flat = np.concatenate([sets[d] for d in full])
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            for k in range(HASHES):
                value = (((flat ^ _SEED[k]) * _ODD[k]) >> np.uint64(32)).astype(np.uint32)
                least[full, k] = np.minimum.reduceat(value, starts)
            ids[full, 0] = np.add.reduceat(mix(flat + np.uint64(1)), starts)
            ids[full, 1] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
        wide = least.astype(np.uint64)
        # Adding the key's number keeps the tables of different keys apart.
        keys = mix((wide[:, 0::2] << np.uint64(32)) | wide[:, 1::2])
        keys = mix(keys + np.arange(2 * SIDE, dtype=np.uint64)[None, :])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(sizes),
                pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array([x.tobytes() for x in least], pa.binary()), _lists(keys),
            ],
            names=["doc_id", "n_shingles", "set_id", "minhashes", "keys"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (of the whole set), minhashes and short keys of every text."""
    return docs.select("doc_id", "text").mapInArrow(
        _signatures,
        "doc_id long, n_shingles long, set_id binary, minhashes binary, keys array<long>",
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = [x.tobytes() for x in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "shingles"]
        )


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
        linked = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y)
            common = both - len(np.union1d(x, y))
            linked.append(100 * common >= 75 * (both - common))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())],
            names=["a", "b", "linked"],
        )


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.75 or more."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    tested = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return tested.mapInArrow(_similar, "a long, b long, linked boolean").where("linked")


def _sizes_allow(a: str, b: str):
    return (100 * F.least(a, b) >= 75 * F.greatest(a, b))


class _Block:
    """Nodes of one or two blocks, and which of them may be linked beyond what is known."""

    def __init__(self, key: tuple, table: pa.Table):
        self.node = table.column("node").to_numpy()
        self.n = table.column("n_shingles").to_numpy()
        self.known = table.column("component").to_numpy()
        least = np.frombuffer(b"".join(table.column("minhashes").to_pylist()), np.uint32)
        self.least = least.reshape(-1, HASHES)
        block, low, high = table.column("block").to_numpy(), key[1].as_py(), key[2].as_py()
        self.ones, self.others = np.flatnonzero(block == low), np.flatnonzero(block == high)
        self.label = np.arange(len(self.node))
        self.forest: list[tuple[int, int]] = []

    def likely(self):
        """Each node of the first block with the later or other nodes it is likely similar to."""
        for i in self.ones:
            rest = self.others[self.node[self.others] > self.node[i]]
            if len(self.ones) and len(self.others) and self.others[0] != self.ones[0]:
                rest = self.others[self.node[self.others] != self.node[i]]
            rest = rest[(self.known[rest] != self.known[i]) & (self.label[rest] != self.label[i])]
            small, large = np.minimum(self.n[rest], self.n[i]), np.maximum(self.n[rest], self.n[i])
            rest = rest[100 * small >= 75 * large]
            rest = rest[(self.least[rest] == self.least[i]).sum(1) >= AGREE]
            if len(rest):
                yield i, rest

    def tie(self, i: int, rest: np.ndarray) -> None:
        """One edge to each tree among ``rest`` that node i is not in yet."""
        trees, where = np.unique(self.label[rest], return_index=True)
        for tree, j in zip(trees, rest[where], strict=True):
            if tree != self.label[i]:
                self.forest.append((self.node[i], self.node[j]))
                self.label[self.label == tree] = self.label[i]

    def edges(self) -> pa.Table:
        pairs = np.sort(np.array(self.forest, np.int64).reshape(-1, 2), 1)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _likely_forest(key: tuple, table: pa.Table) -> pa.Table:
    # In one order everywhere, forests of buckets that share nodes share most edges.
    block = _Block(key, table.sort_by("node"))
    for i, rest in block.likely():
        block.tie(i, rest)
    return block.edges()


def _linked_forest(key: tuple, table: pa.Table) -> pa.Table:
    block = _Block(key, table)
    # What is known to be one component is one tree from the start.
    _, block.label = np.unique(block.known, return_inverse=True)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    for i, rest in block.likely():
        own = sets[i]
        flat = np.concatenate([sets[j] for j in rest])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        starts = np.concatenate(([0], np.cumsum([len(sets[j]) for j in rest])[:-1]))
        common = np.add.reduceat((own[place] == flat).astype(np.int64), starts)
        linked = 100 * common >= 75 * (block.n[rest] + block.n[i] - common)
        if linked.any():
            block.tie(i, rest[linked])
    return block.edges()


def _paired(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Each row for all pairs of its block with a block of the same ``key``, as low and high."""
    return (
        rows.withColumn("_blocks", blocks.cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")})
        .drop("_blocks", "_other")
        .withColumnRenamed(key, "key")
    )


def links(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """Written links (a, b) between least documents of different sets, enough for all components.

    ``signed`` is the written result of ``signatures(docs)``.
    """
    nodes = (
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
            F.first("minhashes").alias("minhashes"), F.first("keys").alias("keys"),
        )
        .drop("set_id")
    )
    nodes = written(nodes)
    short = nodes.select("node", "n_shingles", F.posexplode("keys").alias("place", "short"))
    repeated = short.groupBy("short").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    sides = (
        short.join(repeated, "short")
        .groupBy("node", "n_shingles")
        .agg(
            F.collect_list(F.when(F.col("place") < SIDE, F.col("short"))).alias("first"),
            F.collect_list(F.when(F.col("place") >= SIDE, F.col("short"))).alias("second"),
        )
        .select("node", "n_shingles", F.explode("first").alias("one"), "second")
        .select("node", "n_shingles", "one", F.explode("second").alias("two"))
        .select("node", "n_shingles", F.xxhash64("one", "two").alias("key"))
    )
    keyed = written(sides)
    buckets = keyed.groupBy("key").agg(
        F.min(F.struct("node", "n_shingles")).alias("least"), F.count("*").alias("n")
    )
    members = written(
        keyed.join(buckets.where("n > 1"), "key").select(
            "key", "node", "n_shingles", F.col("least.node").alias("leader"),
            F.col("least.n_shingles").alias("leader_shingles"),
        )
    )
    stars = (
        members.where("node <> leader").where(_sizes_allow("n_shingles", "leader_shingles"))
        .select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    )
    near = members.select("node").distinct()
    texts = docs.select("doc_id", "text").join(
        near.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"
    )
    sets = written(texts.mapInArrow(_sets, "node long, shingles binary"))
    first = written(_confirmed(stars, sets).select("a", "b"))
    label = components(first)
    known = nodes.select("node", "n_shingles", "minhashes").join(label, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    others = members.where("node <> leader").join(
        label, "node", "left"
    ).withColumn("component", F.coalesce("component", "node"))
    # Buckets of the same nodes are one.
    mixed = (
        others.groupBy("key")
        .agg(
            F.min("component").alias("least"), F.max("component").alias("most"),
            F.count("*").alias("count"), F.sum(F.xxhash64("node") % (1 << 40)).alias("who"),
        )
        .where("least <> most")
        .groupBy("least", "most", "count", "who").agg(F.min("key").alias("key"))
        .select("key", "count")
    )
    # A node has at most one key in each table, so its keys fit a row, and it is joined once.
    keys = others.select("key", "node").join(mixed, "key").groupBy("node").agg(
        F.collect_list(F.struct("key", "count")).alias("keys")
    )
    buckets = keys.join(known, "node").select("*", F.inline("keys")).drop("keys")
    buckets = _paired(buckets, "key", F.ceil(F.col("count") / BLOCK))
    rough = buckets.groupBy("key", "low", "high").applyInArrow(_likely_forest, "a long, b long")
    trees = components(rough).withColumnRenamed("component", "tree")
    grown = written(trees.join(known, "node"))
    sizes = grown.groupBy("tree").agg(F.sum("n_shingles").alias("total"))
    grown = grown.join(sizes, "tree").join(sets, "node")
    grown = _paired(grown, "tree", F.ceil(F.col("total") / BLOCK_SHINGLES))
    rest = grown.groupBy("key", "low", "high").applyInArrow(_linked_forest, "a long, b long")
    return written(first.union(rest))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text, …).

    Null and blank texts have an empty set and are linked with nothing. A null doc_id takes no
    part: its component_id is null and it is kept. Rows that repeat a doc_id each get a row; a
    doc_id that occurs with several texts is one node in each of their groups.
    """
    signed = written(signatures(docs))
    found = components(links(signed, docs))
    least = (
        signed.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("node"))
        .join(found, "node", "left")
        .select("set_id", F.coalesce("component", "node").alias("component"))
    )
    joined = signed.select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id")
    ).join(least, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns; one document of each group stays."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
