import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from liveops.llm import vafile

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, every=50, k=5):
    usable = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None
              and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in {i for i, _ in usable if i % every == 0}:
        mine = min(v for i, v in usable if i == q)
        scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in usable if i != q and len(v) == len(mine))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def got(vectors):
    return {tuple(r) for r in vafile.top_k(vectors).select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("block", [8192, 16])
def test_random(spark, monkeypatch, block):
    """Ties, copies, long and short vectors, two sizes, small blocks."""
    monkeypatch.setattr(vafile, "BLOCK", block)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-3, 3)]) for _ in range(8)]) for i in range(420)]
    rows += [(i, rows[7][1]) for i in range(420, 520)]
    rows += [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(1000, 1004)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [1.0, float("nan")]), (None, [9.0, 9.0]),
        (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [-1e6, 5.0]), (200, [1.0, 1.0]), (250, [float("inf"), 0.0]), (300, []),
    ]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("clash"), "block": F.lit(1)})
    assert got(vectors) == plain(rows)
    assert vafile.top_k(vectors.limit(0)).count() == 0


def test_bounds():
    rng = np.random.default_rng(3)
    v, q = rng.integers(-900, 900, (200, 6)).astype(float), rng.integers(-900, 900, (9, 6)).astype(float)
    grid = vafile.Grid(v.min(0), v.max(0))
    low, high = grid.bounds(q, grid.cells(v))
    assert (low <= q @ v.T).all() and (q @ v.T <= high).all()


def test_products_beyond_single_precision(spark):
    """Many near copies, whose products differ by less than rounding does."""
    rng = random.Random(5)
    first = [rng.randint(-9000, 9000) for _ in range(8)]
    rows = [(i, [float(x + rng.randint(0, 1)) for x in first]) for i in range(300)]
    rows += [(i, [2.0 ** 60, float(i)]) for i in range(300, 304)]  # products beyond single precision's range
    vectors, want = spark.createDataFrame(rows, SCHEMA), plain([r for r in rows if r[0] < 300])
    assert {r for r in got(vectors) if r[0] < 300} == want
    assert got(vectors.where("vec_id < 300")) == want


def test_many_vectors_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 32)
    rng = random.Random(6)
    rows = [(i % 3 and 100, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_joins_a_row_a_query(spark, monkeypatch):
    """Rows for each block are many more than the queries from which Spark reckons the size of a broadcast."""
    monkeypatch.setattr(vafile, "BLOCK", 16)
    rng = random.Random(7)
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(500)], SCHEMA)
    joined, join = [], type(vectors).join
    monkeypatch.setattr(type(vectors), "join", lambda self, other, *a: joined.append(self) or join(self, other, *a))
    vafile.top_k(vectors)
    assert [df.count() for df in joined] == [10]


def test_products_of_a_block_in_parts():
    """No step holds all products of a pair of blocks."""
    rng = np.random.default_rng(8)
    v, q = rng.integers(-99, 99, (vafile.BLOCK, 8)), rng.integers(-99, 99, (4096, 8))
    grid, ids, names = vafile.Grid(v.min(0).astype(float), v.max(0).astype(float)), np.arange(len(v)), np.arange(len(q))
    tracemalloc.start()
    try:
        asked, least = vafile._floors(grid, grid.cells(v.astype(float)), ids, q.astype(float), names, 5)
        assert (np.bincount(asked) == 5).all()
        floor = least.reshape(-1, 5).min(1)
        found = vafile._best(grid, v, ids, q, names, floor, 5)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8 * len(v) * len(q) / 2
    scores = q[:9] @ v.T
    scores[np.arange(9), np.arange(9)] = -(1 << 60)
    best = [np.lexsort((ids, -s))[:5] for s in scores]
    assert [i for b in best for i in b] == found[1][:45].tolist()
    assert [s[i] for s, b in zip(scores, best) for i in b] == found[2][:45].tolist()
