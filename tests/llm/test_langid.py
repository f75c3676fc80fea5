import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from liveops.llm import langid


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    got = [(r.lang == r.lang_pred, r.score) for r in rows.collect()]
    assert len(got) > 20 and np.mean([ok for ok, _ in got]) >= 0.97
    assert all(0 <= s <= 1 for _, s in got)


def plain(field, scores):
    """Label probabilities of one text by a plain loop, and those given only what stands before."""
    e = np.exp(scores)
    alpha, beta = [np.exp(field.start) * e[0]], [np.ones(scores.shape[1])]
    for i in range(1, len(e)):
        alpha.append(alpha[-1] / alpha[-1].sum() @ np.exp(field.transition) * e[i])
    for i in range(len(e) - 1, 0, -1):
        beta.append(np.exp(field.transition) @ (e[i] * beta[-1]))
        beta[-1] /= beta[-1].sum()
    alpha = np.array(alpha)
    both = alpha * np.array(beta[::-1])
    return both / both.sum(1, keepdims=True), alpha / alpha.sum(1, keepdims=True)


def random_field(rng, k=3):
    field = langid.Field([f"l{j}" for j in range(k)])
    field.transition, field.start = rng.normal(size=(k, k)), rng.normal(size=k)
    return field


def check_marginals(field, rng, sizes):
    scores = rng.normal(size=(sum(sizes), len(field.labels))) * 3
    first = np.zeros(len(scores), bool)
    starts = np.cumsum([0, *sizes[:-1]])
    first[starts] = True
    got, before = field.marginals(scores, first)
    for at, n in zip(starts, sizes, strict=True):
        both, one = plain(field, scores[at : at + n])
        np.testing.assert_allclose(got[at : at + n], both, rtol=1e-9, atol=1e-13)
        np.testing.assert_allclose(before[at : at + n], one, rtol=1e-9, atol=1e-13)


def test_marginals():
    """The parallel form equals a plain loop over each text, whatever the number of words."""
    rng = np.random.default_rng(1)
    field = random_field(rng)
    check_marginals(field, rng, [1, 7, 30, 2, 61])
    for n in range(1, 201):
        check_marginals(field, rng, [n])
        check_marginals(field, rng, [int(x) for x in rng.integers(1, 40, n % 7 + 1)])


def test_pieces(monkeypatch):
    """A text cut into pieces has the probabilities it has as a whole."""
    rng = np.random.default_rng(7)
    field = random_field(rng, 4)
    sizes = [3, 400, 1, 50, 51, 120, 2]
    scores = rng.normal(size=(90, 4)) * 2
    codes = rng.integers(0, 90, sum(sizes))
    starts = np.cumsum([0, *sizes[:-1]])
    monkeypatch.setattr(langid, "PIECE", 50)
    got = np.zeros((len(codes), 4))
    for a, chance in field.chances(scores, codes, starts):
        assert len(chance) <= 50
        got[a : a + len(chance)] = chance
    for at, n in zip(starts, sizes, strict=True):
        np.testing.assert_allclose(got[at : at + n], plain(field, scores[codes[at : at + n]])[0], rtol=1e-9)


def test_prediction_against_a_loop(spark, folder):
    """Every text scored by itself with plain features and a plain loop; alone and in any batch."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    field = langid.fit(docs.where(~langid.held_out()))
    rows = docs.select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, field).collect()}
    for row in rows:
        words = [w.lower() for w in plain_words.findall(row.text or "") if any(c.isalpha() for c in w)]
        scores = np.array([plain_score(field, w) for w in words]).reshape(-1, len(field.labels))
        if not words:
            assert got[row.doc_id] == ("und", 0)
            continue
        mean = plain(field, scores)[0].mean(0)
        assert got[row.doc_id][0] == field.labels[mean.argmax()]
        assert abs(got[row.doc_id][1] - mean.max()) < 1e-6
    texts = [r.text for r in rows]
    together = langid._predicted(field, pa.array(texts))
    alone = [langid._predicted(field, pa.array([t])) for t in texts]
    assert together[0] == [names[0] for names, _ in alone]
    assert together[1].tolist() == [best[0] for _, best in alone]


plain_words = re.compile(r"[^\x20\x09-\x0D]+")


def plain_score(field, word):
    """The sum of the weights of a word's features, taken for this word alone."""
    return sum(field.weights[n].astype(float).sum(0) for n, _ in langid._features(pa.array([word])))


def test_fitting_raises_the_likelihood():
    """Labels by a plain forward loop: likelier after fitting, and staying likelier than a switch."""
    rng = np.random.default_rng(9)
    field = langid.Field(["a", "b"])
    words = pa.array([f"{x}{y}" for x in ("ka", "lo", "mi") for y in ("ting", "que")])
    numbers, owners = (np.concatenate(x) for x in zip(*langid._features(words), strict=True))
    order = np.argsort(owners, kind="stable")
    numbers, owners = numbers[order], owners[order]
    starts = np.searchsorted(owners, np.arange(len(words)))
    sequences = []
    for _ in range(200):
        labels = np.repeat(rng.integers(0, 2, 4), rng.integers(3, 9, 4))
        sequences.append((rng.integers(0, 3, len(labels)) * 2 + labels, labels))

    def likelihood():
        scores, total = field.scores(words), 0.0
        for codes, labels in sequences:
            s = scores[codes]
            path = field.start[labels[0]] + s[0, labels[0]]
            log = field.start + s[0]
            for i in range(1, len(codes)):
                path += field.transition[labels[i - 1], labels[i]] + s[i, labels[i]]
                log = np.logaddexp.reduce(log[:, None] + field.transition, axis=0) + s[i]
            total += path - np.logaddexp.reduce(log)
        return total / len(sequences)

    before = likelihood()
    langid._fit(field, sequences, numbers, starts)
    assert likelihood() > before / 10
    assert field.transition[0, 0] > field.transition[0, 1] and field.transition[1, 1] > field.transition[1, 0]


def test_many_labels(spark, monkeypatch):
    """A dirty lang column: the most frequent labels are learned, the sample stays bounded."""
    monkeypatch.setattr(langid, "LABELS", 3)
    monkeypatch.setattr(langid, "DOCS", 4)
    rows = [(i, f"wort{i} und zahl{i}", "de" if i % 2 else "en") for i in range(40)]
    rows += [(100 + i, f"odd{i} text", f"x{i:02}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.sample(docs).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in kept} == {"de": 4, "en": 4, "x00": 1}
    assert langid.fit(docs).labels == ["de", "en", "x00"]


def test_code_switching(spark, make_docs):
    """Words of two languages in one text get their own labels."""
    rng = np.random.default_rng(2)
    left = [f"{a}ting" for a in ("ba", "ko", "mi", "ru", "te")]
    right = [f"{a}que" for a in ("sa", "lo", "vi", "pu", "ne")]
    rows = make_docs({i: " ".join(rng.choice(left, 60)) for i in range(40)}, "x").union(
        make_docs({100 + i: " ".join(rng.choice(right, 60)) for i in range(40)}, "y")
    )
    field = langid.fit(rows)
    mixed = [*left, *right, *left]
    assert langid.word_labels([" ".join(mixed), None, "12"], field) == [
        ["x"] * 5 + ["y"] * 5 + ["x"] * 5, [], [],
    ]


def test_rows(spark, make_docs):
    """Null, empty, letterless and very long texts; a column lang_pred of the input; no rows."""
    good = make_docs({i: "the cat sat on the mat" for i in range(20)}, "en")
    odd = make_docs([
        (101, None), (102, ""), (103, "12 34 !? €"), (104, "the cat " * 40_000), (None, "the mat"),
        (105, "éè"), (105, "éè"),
    ])
    docs = good.union(odd).withColumn("lang_pred", F.lit("clash"))
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(101, "und"), (102, "und"), (103, "und"), (104, "en"), (None, "en"), (105, "en")} <= rows
    kept = langid.in_a_language(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.where("lang IS NULL").collect()) == [0, 104, 105, 105]
    assert langid.identify(docs.limit(0)).count() == 0
    unlabelled = odd.drop("lang").withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_kept_rows(spark, make_docs):
    """Rows that stay keep all columns, null ids, repeats and names that clash among them."""
    good = make_docs({i: "the cat sat on the mat" for i in range(20)}, "en")
    odd = make_docs([(None, "the mat"), (None, "the mat"), (None, None), (7, "the cat"), (8, "1 2")])
    docs = good.union(odd).withColumns({"score": F.lit(3), "hash": F.lit("h"), "n": F.lit(1)})
    kept = langid.in_a_language(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text, r.score, r.hash, r.n) for r in kept.where("lang IS NULL").collect()]
    assert sorted(left, key=str) == [(7, "the cat", 3, "h", 1)] + [(None, "the mat", 3, "h", 1)] * 2
    assert langid.in_a_language(docs.limit(0)).collect() == []


def test_features():
    """A word is the same features wherever it stands."""
    one = langid._features(pa.array(["abc", "é", "a"]))
    two = langid._features(pa.array(["zz", "abc"]))
    of = lambda fs, w: sorted(int(x) for n, o in fs for x in n[o == w])
    assert of(one, 0) == of(two, 1)
