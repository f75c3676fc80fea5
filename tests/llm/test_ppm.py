import math
import random
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from liveops.llm import ppm
from liveops.llm.langid import held_out


def plain_base(texts, held):
    """doc -> (n_tokens, n_known, base score), and all training tokens."""
    tokens = {d: [*plain.words(t), None] for d, t in texts.items()}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    out = {}
    for d, ws in tokens.items():
        score = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out[d] = (len(ws), sum(c[w] > 0 for w in ws), score)
    return out, n


def plain_trie(texts, held, order=ppm.ORDER):
    """doc -> log10 probability under contexts kept in dictionaries, byte by byte."""
    rows = {d: b"\xff" * order + (t or "").translate(plain.LOWER).encode() + b"\xff" for d, t in texts.items()}
    seen = defaultdict(Counter)
    for d, b in rows.items():
        if not held[d]:
            for i in range(order, len(b)):
                for k in range(order + 1):
                    seen[b[i - k : i]][b[i]] += 1

    def prob(context, s):
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            left = {x: n for x, n in seen[context[order - k :]].items() if x not in out}
            total = sum(left.values()) + len(left)
            if s in left:
                return p * left[s] / total
            if total:
                p *= len(left) / total
            out |= set(left)
        return p / (256 - len(out))

    memo = {}

    def cached(context, s):
        if (context, s) not in memo:
            memo[context, s] = math.log10(prob(context, s))
        return memo[context, s]

    scores = {d: sum(cached(b[i - order : i], b[i]) for i in range(order, len(b))) for d, b in rows.items()}
    return scores, prob


def check(docs, texts):
    held = {r.doc_id: r.h for r in docs.select("doc_id", held_out(folds=10).alias("h")).collect()}
    rows = {r.doc_id: r for r in ppm.score(docs, held_out(folds=10)).collect()}
    base, n = plain_base(texts, held)
    trie, prob = plain_trie(texts, held)
    assert set(rows) == set(texts)
    for d, r in rows.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*base[d][:2], n)
        assert r.base_score == pytest.approx(base[d][2], rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(trie[d], rel=1e-9, abs=1e-9)
    return rows, prob


@pytest.mark.parametrize("chunk", [1 << 23, 2000])
def test_small(spark, make_docs, monkeypatch, chunk):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", chunk)
    rng = random.Random(1)
    parts = ["the ", "The", "ting", "é", "ou", "\n", " ", "Σß", "x", "🙂", "zq", "\t"]
    texts = {i: "".join(rng.choice(parts[: 7 + i % 6]) for _ in range(rng.randrange(60))) for i in range(80)}
    texts |= {90: None, 91: "", 92: " \n", 93: "a" * 4000}
    rows, prob = check(make_docs(texts), texts)
    for context in (b"\xff\xff\xff\xff", b"the ", b"zzzz", b"ting"):
        assert sum(prob(context, s) for s in range(256)) == pytest.approx(1)


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    check(docs, {r.doc_id: r.text for r in docs.collect()})


def test_rows(spark, make_docs):
    """Rows that repeat, a null id, clashing columns, no rows, and nothing to learn from."""
    docs = make_docs([(1, "same text"), (1, "same text"), (None, "no id"), (2, "other")])
    docs = docs.withColumns({"chunk": F.lit("clash"), "held": F.lit(1)})
    rows = ppm.score(docs, held_out(folds=10)).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert ppm.score(docs.limit(0), held_out(folds=10)).count() == 0
    blind = ppm.score(docs, F.lit(True)).collect()
    for r in blind:
        size = len({1: "same text", 2: "other", None: "no id"}[r.doc_id]) + 1
        assert r.score == pytest.approx(-size * math.log10(256)) and r.train_tokens == 0
        assert r.base_score == 0 and r.n_known == 0


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 300_000))
    found = ppm._Lookup(keys, np.arange(len(keys)))
    assert (found(keys) == np.arange(len(keys))).all()
