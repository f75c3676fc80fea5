import random

import plain
import pytest
from pyspark.sql import functions as F

from liveops.llm import neardup
from liveops.llm.components import components


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def vary(words, share, rng):
    return " ".join(w if rng.random() > share else rng.choice(words) for w in words)


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got(neardup.near_duplicates(docs)) == plain.near_duplicates(texts)


@pytest.mark.parametrize("block", [2048, 8])
def test_groups(spark, make_docs, monkeypatch, block):
    """Many near copies of one text, a shared passage in unlike texts, exact copies."""
    rng = random.Random(3)
    word = [f"w{i}" for i in range(400)]
    base = [rng.choice(word) for _ in range(120)]
    passage = " ".join(rng.choice(word) for _ in range(60))
    texts = {}
    for i in range(60):
        texts[i] = vary(base, rng.choice([0.01, 0.02, 0.03, 0.04, 0.06]), rng)
        texts[100 + i] = passage + " " + " ".join(rng.choice(word) for _ in range(30))
        texts[200 + i] = "the same text again and again " * (1 + i % 3)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block * 100)
    assert got(neardup.near_duplicates(make_docs(texts))) == plain.near_duplicates(texts)


def test_odd_rows(spark, make_docs):
    """Null, empty and blank texts stand alone; short texts match whole; a null id takes no part."""
    long = "long words here " + "x" * 200_000
    pairs = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "two one"),
        (7, long), (8, long), (None, "one two"), (9, "a b c d e"), (9, "a b c d e"),
    ]
    docs = make_docs(pairs).withColumn("component_id", F.lit("clash")).withColumn("node", F.lit(1))
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == len(pairs)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert found == {
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
        (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False), (None, 1, None, True), (9, 1, 9, True),
    }
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 9]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_path(spark):
    """A long path is one component."""
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(path).collect()} == {0}
