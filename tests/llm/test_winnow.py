"""Winnowing against a plain loop, its match guarantee, and the edited texts."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from liveops.llm import winnow

MASK = (1 << winnow.HASH_BITS) - 1


def plain(text, gram=winnow.GRAM, window=winnow.WINDOW):
    """[(hash, position)]: of every window the least hash, the rightmost of equal ones."""
    if not text:
        return []
    runs = [text[i : i + gram] for i in range(len(text) - gram + 1)] or [text]
    values = [xxhash.xxh64(r.encode(), seed=42).intdigest() >> (63 - winnow.HASH_BITS) & MASK for r in runs]
    out = []
    for i in range(max(1, len(values) - window + 1)):
        seen = values[i : i + window]
        at = i + max(j for j, v in enumerate(seen) if v == min(seen))
        if not out or out[-1][1] != at:
            out.append((values[at], at))
    return out


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def found(spark, texts, **sizes):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows.select("i", winnow.fingerprint(F.col("text"), **sizes).alias("f")).collect()
    return {r.i: None if r.f is None else [tuple(x) for x in r.f] for r in got}


def texts():
    rng = random.Random(2)
    out = ["", "a", "ab", "a" * 500, "ab" * 300, "é" * 11, "日本語" * 9, "🙂x" * 80, "\n \t\r" * 30]
    for n in (11, 12, 13, 42, 43, 44, 60, 100, 999, 3_000):
        out.append("".join(rng.choice("abc dé🙂\n") for _ in range(n)))
    return out


@pytest.mark.parametrize("gram, window, block", [(12, 32, 1 << 16), (3, 4, 16), (5, 8, 10), (1, 1, 7), (4, 2, 1)])
def test_against_a_loop(spark, gram, window, block):
    got = found(spark, [*texts(), None], gram=gram, window=window, block=block)
    for i, text in enumerate(texts()):
        assert got[i] == plain(text, gram, window), (i, text[:50])
    assert got[len(texts())] is None


def test_long_text(spark):
    """Several blocks of the size that is used; positions go on over their seams."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh 🙂") for _ in range(150_000)) + "z" * 70_000
    assert found(spark, [text])[0] == plain(text)


def test_guarantee(spark):
    """A shared passage of gram + window - 1 code points leaves a hash at its place in both."""
    rng = random.Random(4)
    length = winnow.GRAM + winnow.WINDOW - 1
    rows = []
    for _ in range(60):
        shared, *rest = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (length, 90, 50, 70, 20))
        rows += [(rest[0] + shared + rest[1], len(rest[0])), (rest[2] + shared + rest[3], len(rest[2]))]
    got = found(spark, [t for t, _ in rows])
    for i in range(0, len(rows), 2):
        places = [{(h, p - rows[j][1]) for h, p in got[j] if 0 <= p - rows[j][1] < winnow.WINDOW} for j in (i, i + 1)]
        assert places[0] & places[1]


def expected(rows):
    """(doc_id, n_chars, sha, fingerprint, edited, near_edited, near_next), by document in order."""
    rows = sorted(
        ((d, t or "") for d, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest())),
    )
    out = []
    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b = plain(text), plain(edited)
        out.append((
            d, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b),
            likeness(a, b), likeness(a, plain(after)),
        ))
    return sorted(out, key=str)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def show(f):
    return ",".join(f"{h:x}:{p}" for h, p in f)


def result(spark, rows):
    docs = spark.createDataFrame(
        [(d, t, 1, "p", 2) for d, t in rows], "doc_id long, text string, version int, _part string, found int"
    )
    got = winnow.edited(docs).select(
        "doc_id", F.length("text").cast("long"), F.sha2("edited_text", 256), winnow.shown(F.col("found")),
        winnow.shown(F.col("edited_found")), "near_edited", "near_next",
    )
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_edited_texts(spark):
    rng = random.Random(5)
    pool = [*texts(), None]
    rows = [(d, rng.choice(pool)) for d in rng.sample(range(-500, 500), 300)]
    assert result(spark, rows) == expected(rows)


def test_null_ids_repeated_and_few_rows(spark):
    rng = random.Random(6)
    pool = [*texts(), None]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(pool)) for _ in range(60)]
    rows += [(None, "the same text again and again, and once more") for _ in range(40)]
    assert result(spark, rows) == expected(rows)
    for rows in ([], [(5, "a text of its own that follows itself, all by itself")], [(1, "ab"), (2, None)]):
        assert result(spark, rows) == expected(rows)


def test_no_python_worker(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = winnow.edited(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_table(spark, folder):
    from liveops.llm.queries import QUERIES

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_winnowing"](spark, folder)
    assert got.columns == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    ]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected([tuple(r) for r in docs])
