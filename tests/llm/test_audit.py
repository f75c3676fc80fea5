"""Filter interactions against a loop over documents and orders."""

import itertools
import random

import pytest

from liveops.llm import audit
from plain import SPACE

DOCS = "doc_id long, text string, lang string, part string, n long, good int"
LABELS = "doc_id long, quality int, toxic int, n string"


def fails(text, doc_id, rows):
    text = text or ""
    words = SPACE.findall(text)
    return {
        "A": len(words) < audit.MIN_WORDS,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and any(
            (t or "") == text and d is not None and d < doc_id for d, t, _ in rows
        ),
    }


def plain(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    out = {}
    failed = [(d, lang or "", fails(t, d, rows)) for d, t, lang in rows]
    for part in {p for _, p, _ in failed}:
        shapley = dict.fromkeys(audit.FILTERS, 0)
        for order in itertools.permutations(audit.FILTERS):
            name = "".join(order)
            left = [(d, f) for d, p, f in failed if p == part]
            everyone = list(left)
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                shapley[x] += len(gone)
                out[part, name, step] = [
                    len(left), len(gone), sum(f[x] for _, f in everyone) - len(gone),
                    sum(f[x] and sum(f.values()) == 1 for _, f in everyone),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
                everyone = [(d, f) for d, f in everyone if not (f[x] and (d, f) in gone)] + gone
        for (p, name, step), row in out.items():
            if p == part:
                row.append(shapley[name[step - 1]])
    return out


def texts(rng):
    base = [f"word{i}" for i in range(200)]
    kinds = [
        None, "", " \t\n\x0b\x0c\r ", "one", "ONE TWO", " ".join(base[:100]), " ".join(base[:99]),
        " ".join(base[:80] + base[:20]), " ".join(base[:79] + base[:21]), " ".join(base[:120]) + " 5 %",
        " ".join(base[:100]).upper(), "Aé" * 300, "a b " * 130, "x" * 5_000, "\x1c\x1d y" * 60,
    ]
    return [rng.choice(kinds) for _ in range(60)]


def result(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, lang, "p", 1, 2) for d, t, lang in rows], DOCS)
    marked = spark.createDataFrame([(d, q, t, "n") for d, q, t in labels], LABELS)
    got = audit.audit(docs, marked)
    assert got.columns == ["part", "filter_order", "step", *audit.COUNTS]
    collected = [tuple(r) for r in got.collect()]
    out = {r[:3]: list(r[3:]) for r in collected}
    assert len(out) == len(collected)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_loops(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice([None, *range(25)]), t, rng.choice([None, "", "en", "fr"])) for t in texts(rng)
    ]
    labels = [
        (rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]))
        for _ in range(25)
    ]
    assert result(spark, rows, labels) == plain(rows, labels)


def test_many_copies_of_one_text(spark):
    """A group of copies, repeated rows among them: all but the least doc_id fail E."""
    rows = [(i // 2, "same text", "en") for i in range(400)]
    got = result(spark, rows, [(0, 1, 0), (3, 0, 1)])
    assert got == plain(rows, [(0, 1, 0), (3, 0, 1)])
    assert got["en", "EABCD", 1][:2] == [2, 398]


def test_empty_tables(spark):
    assert result(spark, [], [(1, 1, 1)]) == {}
    got = result(spark, [(None, None, None)], [])
    assert len(got) == 600 and got["", "BCDEA", 5] == [0, 1, 0, 1, 0, 0, 120]


def test_integers():
    """Fields neither mix nor run over, also for counts near the largest."""
    most = 2**62
    counts = audit.unpacked(most * audit.packed(0b00001, True, False) + 7 * audit.packed(0, False, True))
    at = audit.ORDERS.index("ABCDE")
    assert counts[at, 0].tolist()[:6] == [7, most, 0, most, most, 0]
    assert counts[at, 4].tolist()[:6] == [7, 0, 0, 0, 0, 0]


def test_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    got = {tuple(r)[:3]: list(r)[3:] for r in audit.audit(docs, labels).collect()}
    assert got == plain(rows, marks)
