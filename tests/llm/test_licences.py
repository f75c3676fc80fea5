import random

import plain
import pyarrow as pa
from pyspark.sql import functions as F

from liveops.llm import licences
from liveops.llm.queries import QUERIES


def got(docs):
    rows = licences.scan(docs).collect()
    return {r.doc_id: (r.n_words, list(zip(r.phrase_starts, r.phrase_labels))) for r in rows}


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r.doc_id: plain.phrases(r.text, licences.PHRASES) for r in docs.collect()}
    assert got(docs) == want
    for r in QUERIES["op5_licences"](spark, folder).collect():
        n, places = want[r.doc_id]
        assert (r.n_words, r.n_base) == (n, len(places)) and 0 <= r.score <= 1
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_automaton():
    """Match lengths are those of the longest stretch in any template that ends at each place."""
    rng = random.Random(7)
    for _ in range(40):
        texts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        machine = licences.Automaton()
        for t in texts:
            machine.add(t)
        stretches = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        words = [rng.randrange(1, 5) for _ in range(30)]
        _, lengths = machine.walk(words)
        for end in range(len(words)):
            want = max((n for n in range(1, end + 2) if tuple(words[end + 1 - n : end + 1]) in stretches), default=0)
            assert lengths[end] == want


def test_spans(spark, make_docs):
    """Whole, edited and cut templates; words between; clean texts; odd rows."""
    mit = dict(licences.TEMPLATES)["mit-text"]
    words = mit.split()
    edited = " ".join(w if i % 15 else "changed" for i, w in enumerate(words))
    docs = make_docs([
        (1, f"some code {mit} more"), (2, edited), (3, " ".join(words[:12])), (4, "permission to copy is granted"),
        (5, None), (6, ""), (7, "MIT  License\nmit-license x gnu general public license " * 3000),
        (None, "cc by"), (8, "All rights reserved."), (8, "All rights reserved."),
    ]).withColumn("spans", F.lit("clash"))
    rows = licences.scan(docs).collect()
    assert len(rows) == 10
    spans = {r.doc_id: [s.label for s in r.spans] for r in rows}
    assert spans[1] == ["mit-text"] and spans[2] == ["mit-text"] and spans[8] == ["all-rights-reserved"]
    assert not spans[3] and not spans[4] and not spans[5] and not spans[6]
    one = next(r for r in rows if r.doc_id == 1).spans[0]
    assert (one.first, one.covered) == (2, one.template_words) and one["last"] == one.template_words + 1
    found = {r.doc_id: (r.n_words, len(r.phrase_starts)) for r in rows}
    assert found[7] == (27_000, 9000) and found[None] == (2, 1) and found[5] == (0, 0)
    assert licences.scan(docs.limit(0)).count() == 0


def test_overlapping_phrases():
    scanner = licences.Scanner((), {"a b": "x", "b a b": "y", "b": "z"})
    codes = [scanner.number.get(w, 0) for w in "a b a b c b".split()]
    hits, _ = scanner.read(pa.array(codes).to_numpy())
    assert sorted(hits) == sorted([(0, 0), (2, 0), (1, 1), (1, 2), (3, 2), (5, 2)])
