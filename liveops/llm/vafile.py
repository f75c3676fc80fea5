"""Exact search for the largest inner products with a vector-approximation file.

Vectors of whole numbers are approximated by one cell per component: ``CELLS`` equal parts of
what that component ranges over, one byte each. From the cells alone follow bounds of the inner
product with a query, and the kth largest lower bound of a query over all vectors is a floor for
its result. Then each block of vectors is read again: those whose upper bound reaches the floor
are compared exactly, highest bounds first, and then those whose bound reaches the kth score found.

Queries and vectors are dealt into blocks by a hash, and each pair of blocks meets in one task,
which holds the products of a few queries at a time; a block yields ``k`` rows per query at most.
The number of blocks follows the counts, so tasks stay of one size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liveops.session import written

CELLS = 64
#: Vectors and queries of a block.
BLOCK, QUERY_BLOCK = 8192, 16384
#: Products, or components of vectors compared exactly, that a task holds at once.
CHUNK = 1 << 22


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def whole_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, vector (floor(scale * x) of each component) and size of the usable ``vectors``.

    Vectors that are null, empty or hold a null or a number that is not finite take no part, nor do
    those with a null vec_id.
    """
    x = F.col("embedding").cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select("vec_id", x.alias("embedding"))
        .where((F.size("embedding") > 0) & F.col("vec_id").isNotNull() & fine)
        .select(
            "vec_id", F.size("embedding").alias("size"),
            F.transform("embedding", lambda v: F.floor(v * scale).cast("long")).alias("vector"),
        )
    )


def _ranges(whole: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and largest value of each component, by size of vector."""
    rows = (
        whole.select("size", F.posexplode("vector").alias("at", "value")).groupBy("size", "at")
        .agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    )
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {r["size"] for r in rows}:
        mine = sorted((r["at"], r["low"], r["high"]) for r in rows if r["size"] == size)
        out[size] = np.array([m[1] for m in mine], float), np.array([m[2] for m in mine], float)
    return out


class Grid:
    """Cells of one size of vector, and bounds of inner products from them.

    A component's cells are equally wide, so a product with any vector of a cell is within one
    ``reach`` of the query's product with the middle of the cell, whatever the cell.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low
        self.width = np.floor((high - low) / CELLS) + 1
        most = np.maximum(np.abs(low), np.abs(low + CELLS * self.width))
        # Single precision where no product can overflow it; what rounding can add is in ``off``.
        self.kind = np.float32 if len(low) * most.max(initial=0) ** 2 < 1e30 else np.float64
        self.off = (self.width - 1) / 2 + (len(low) + 8) * np.finfo(self.kind).eps * most

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def near(self, queries: np.ndarray, cells: np.ndarray):
        """Parts (slice of the queries, their products with the middles of all cells)."""
        middles = (self.low + cells * self.width + (self.width - 1) / 2).astype(self.kind).T
        step = max(1, CHUNK // max(1, len(cells)))
        for at in range(0, len(queries), step):
            part = slice(at, at + step)
            yield part, queries[part].astype(self.kind) @ middles

    def reach(self, queries: np.ndarray) -> np.ndarray:
        return np.abs(queries) @ self.off

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each query with what lies in each row of cells."""
        near = np.concatenate([n for _, n in self.near(queries, cells)]).astype(float)
        reach = self.reach(queries)[:, None]
        return near - reach, near + reach


def _own(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``names``, in ``ids``) of equal ids, in order of the first."""
    order = np.argsort(ids, kind="stable")
    first = np.searchsorted(ids[order], names, "left")
    count = np.searchsorted(ids[order], names, "right") - first
    row = np.repeat(np.arange(len(names)), count)
    return row, order[np.arange(len(row)) + np.repeat(first - np.cumsum(count) + count, count)]


def _places(row: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its row; rows stand together."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))


def _scores(vectors: np.ndarray, queries: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact products of the pairs (row of ``queries``, row of ``vectors``)."""
    out, step = np.empty(len(row), np.int64), max(1, CHUNK // max(1, vectors.shape[1]))
    for at in range(0, len(row), step):
        part = slice(at, at + step)
        out[part] = np.einsum("ij,ij->i", queries[row[part]], vectors[col[part]])
    return out


def _floors(grid: Grid, cells: np.ndarray, ids: np.ndarray, queries: np.ndarray, names: np.ndarray, k: int):
    """(query, lower bound) of the ``k`` largest lower bounds of each query."""
    out = [(np.zeros(0, np.int64), np.zeros(0))]
    reach, (row, col) = grid.reach(queries), _own(names, ids)
    for part, near in grid.near(queries, cells):
        mine = slice(*np.searchsorted(row, [part.start, part.stop]))
        near[row[mine] - part.start, col[mine]] = -np.inf
        if near.shape[1] > k:
            near = np.partition(near, near.shape[1] - k, axis=1)[:, -k:]
        low = near.astype(float) - reach[part, None]
        there = low > -np.inf
        out.append((np.repeat(names[part], there.sum(1)), low[there]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _best(grid: Grid, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, names: np.ndarray,
          floor: np.ndarray, k: int):
    """(query, vec_id, score) of the ``k`` best of each query, of those that reach its floor."""
    out = [(np.zeros(0, np.int64),) * 3]
    asked = queries.astype(float)
    reach = grid.reach(asked)
    least = np.nextafter((floor - reach).astype(grid.kind), grid.kind(-np.inf))
    for part, near in grid.near(asked, grid.cells(vectors.astype(float))):
        row, col = np.nonzero(near >= least[part, None])
        high = near[row, col] + reach[part][row]
        row += part.start
        other = ids[col] != names[row]
        row, col, high = row[other], col[other], high[other]
        order = np.lexsort((-high, row))
        row, col, high = row[order], col[order], high[order]
        first = _places(row) < 4 * k
        found = _scores(vectors, queries, row[first], col[first])
        # The kth score found so far of each query: what cannot reach it is not compared.
        order = np.lexsort((-found, row[first]))
        kth = _places(row[first]) == k - 1
        reached = np.full(len(queries), -np.inf)
        reached[row[first][kth]] = found[order][kth]
        rest = ~first & (high >= reached[row])
        score = np.append(found, _scores(vectors, queries, row[rest], col[rest]))
        row, got = np.append(row[first], row[rest]), ids[np.append(col[first], col[rest])]
        order = np.lexsort((got, -score, row))
        order = order[_places(row[order]) < k]
        out.append((names[row[order]], got[order], score[order]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of each query.

    Queries are the vectors whose vec_id is divisible by ``every``; the candidates of a query are
    all vectors of its size but those with its own vec_id. Ties go to the smaller vec_id; fewer
    candidates give fewer rows. Rows that repeat vec_id and vector are one; with different
    vectors a vec_id is several candidates, and as a query the one of its least vector.
    Products are exact below 2^53.
    """
    whole = written(whole_vectors(vectors, scale).distinct())
    counts = {r["size"]: (r["n"], r["m"]) for r in whole.groupBy("size").agg(
        F.count("*").alias("n"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("m")
    ).collect()}
    ranges = _ranges(whole)
    grids = {size: Grid(*r) for size, r in ranges.items()}
    most = max((np.abs(r).max() for r in ranges.values()), default=0)
    kind = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    of_size = {s: -(-n // BLOCK) for s, (n, _) in counts.items()}
    asked_of_size = {s: max(1, -(-m // QUERY_BLOCK)) for s, (_, m) in counts.items()}
    # A task for each pair of blocks; hashing puts some together, less so with room to spare.
    tasks = min(max(1, 2 * sum(n * asked_of_size[s] for s, n in of_size.items())), 100_000)

    def blocks(of: dict[int, int]):
        return F.create_map(*[F.lit(x) for item in of.items() for x in item] or [F.lit(0), F.lit(1)])

    numbered = whole.select(
        "vec_id", "size", F.col("vector").cast(f"array<{kind}>").alias("vector"),
        blocks(of_size)[F.col("size")].alias("blocks"),
        blocks(asked_of_size)[F.col("size")].alias("query_blocks"),
    )
    key = ["size", "block", "query_block"]
    in_key = [f"in_{c}" for c in key]

    def dealt(rows: DataFrame, column: str) -> DataFrame:
        """A row for each block of queries."""
        each = F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))
        return rows.select("size", "block", "vec_id", column, each.alias("query_block")).repartition(tasks, *key)

    def asked(rows: DataFrame, *more: str) -> DataFrame:
        """A row for each block of vectors."""
        return rows.select(
            F.col("size").alias("in_size"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), *more,
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("in_block"),
            F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int").alias("in_query_block"),
        ).repartition(tasks, *in_key)

    candidates = numbered.select(
        "size", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int").alias("block"), "vec_id",
        "vector", "query_blocks",
    )
    queries = numbered.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = queries.groupBy("vec_id", "size", "blocks", "query_blocks").agg(F.min("vector").alias("vector"))

    def cells(batches):
        names = ["size", "block", "vec_id", "query_blocks"]
        for batch in batches:
            size = batch.column("size").to_numpy()
            out = np.empty(batch.num_rows, object)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                taken = pa.chunked_array([batch.column("vector").take(pa.array(rows))])
                for i, row in zip(rows, grids[int(s)].cells(_matrix(taken, np.float64)), strict=True):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(out.tolist(), pa.binary())], names=[*names, "cells"]
            )

    file = candidates.mapInArrow(cells, "size int, block int, vec_id long, query_blocks int, cells binary")

    def floors(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ``k`` largest lower bounds of each query in this block."""
        names, least = np.zeros(0, np.int64), np.zeros(0)
        if len(left) and len(right):
            coded = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(len(left), -1)
            names, least = _floors(
                grids[left.column("size")[0].as_py()], coded, left.column("vec_id").to_numpy(),
                _matrix(right.column("query"), np.float64), right.column("query_id").to_numpy(), k,
            )
        return pa.table({"query_id": names, "least": least})

    lower = dealt(file, "cells").groupBy(*key).cogroup(asked(queries).groupBy(*in_key)).applyInArrow(
        floors, "query_id long, least double"
    )
    largest = Window.partitionBy("query_id").orderBy(F.desc("least"))
    kth = lower.withColumn("at", F.row_number().over(largest)).where(F.col("at") == k)
    # With fewer than k candidates every one is a result.
    reached = queries.join(kth.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left").withColumn(
        "floor", F.coalesce("least", F.lit(float("-inf")))
    )

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ``k`` best of this block for each query."""
        names = ids = scores = np.zeros(0, np.int64)
        if len(left) and len(right):
            names, ids, scores = _best(
                grids[left.column("size")[0].as_py()], _matrix(left.column("vector"), np.int64),
                left.column("vec_id").to_numpy(), _matrix(right.column("query"), np.int64),
                right.column("query_id").to_numpy(), right.column("floor").to_numpy(), k,
            )
        return pa.table({"query_id": names, "vec_id": ids, "score": scores})

    best = dealt(candidates, "vector").groupBy(*key).cogroup(asked(reached, "floor").groupBy(*in_key)).applyInArrow(
        exact, "query_id long, vec_id long, score long"
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
