"""Weights, noise and ranks against plain Python over whole texts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from liveops.llm import resample
from plain import licence_words


def features(text):
    w = licence_words(text)
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(rows, target):
    """Sorted (doc_id, n_features, weight, score, rank) of (doc_id, text) rows without ties."""
    s = Counter(bucket(f) for _, t in rows for f in features(t))
    t = Counter(bucket(f) for x in target for f in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
        for b in s
    }
    out = []
    for d, text in rows:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None])
    able = [row for row, (_, t) in zip(out, rows, strict=True) if len(licence_words(t)) >= 20]
    able.sort(key=lambda row: (-row[3], -1 if row[0] is None else row[0]))
    for rank, row in enumerate(able[: 25 * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


def result(spark, rows, target):
    docs = spark.createDataFrame(
        [(d, t, "w", 1, 2, b"k") for d, t in rows],
        "doc_id long, text string, weight string, row long, rank int, key binary",
    )
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = resample.resample(docs, wanted)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "été", "b2b", "x", "of", "日本語", "well-known", "a_b", *map(str, range(30))]
    lines = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(40)]
    lines += ["", " ", "...", "\t", "# --", "same line", "same  line"]
    ends = ["\n", "\n\n", "\r\n", "\n \n", "\n--\n"]
    texts = []
    for _ in range(n):
        text = rng.choice(ends).join(rng.choices(lines, k=rng.randint(0, 12)))
        texts.append(rng.choice([text, text, text + "\n", "\n" + text, None if rng.random() < 0.2 else text]))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    rows = list(enumerate(corpus(seed, 80)))
    target = [*corpus(seed + 50, 15), None, ""]
    assert result(spark, rows, target) == plain(rows, target)


def test_a_line_of_most_documents(spark):
    """One line in every document, within which n-grams count once for each time it stands."""
    hot = "one line that stands in every document there is of this corpus"
    rows = [(i, f"{hot}\n{hot}\nown words {i} {i * 7}\n{hot}") for i in range(300)]
    assert result(spark, rows, [hot]) == plain(rows, [hot])


def test_long_text_and_long_line(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.randint(0, 999)) for _ in range(40_000))
    rows = [(1, long), (2, long.replace(" 7", "\n7")), (3, "x" * 200_000), (4, "short")]
    assert result(spark, rows, [long[:500]]) == plain(rows, [long[:500]])


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, text), (5, f"{text} more"), (6, None), (7, ""), (8, "\n \n"), (9, text), (10, text + " z")]
    assert result(spark, rows, []) == plain(rows, [])
    assert result(spark, [], [text]) == []
    assert result(spark, [(1, None)], [None]) == plain([(1, None)], [None])


def test_repeated_rows(spark):
    """Each is weighed alike; those drawn have ranks of their own."""
    text = " ".join(f"w{i % 9}" for i in range(30))
    got = result(spark, [(3, text)] * 8, [text])
    assert len({row[:4] for row in got}) == 1
    assert sorted(r[4] for r in got if r[4]) == [1, 2]


def test_noise_of_many_ids(spark):
    rows = spark.range(2_000).withColumnRenamed("id", "doc_id").withColumn("noise", resample.noise())
    for row in rows.collect():
        h = int(hashlib.sha256(f"7:{row.doc_id}".encode()).hexdigest()[:8], 16)
        assert row.noise == math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def test_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = resample.resample(docs, target).where(F.col("doc_id").isNotNull()).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, [r.text for r in target.collect()])
