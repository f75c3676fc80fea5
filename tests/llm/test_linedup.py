import random

import plain
import pytest
from pyspark.sql import functions as F

from liveops.llm import linedup


def got(docs, least):
    return {r.doc: sorted(r.lines) for r in linedup.repeated_lines(docs, least).collect()}


@pytest.mark.parametrize("least", [1, 5, 12])
def test_runs(make_docs, least):
    """Runs shared, nested, overlapping and repeated inside a text, against all pairs of places."""
    rng = random.Random(least)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 2, 4, 9]))) for _ in range(12)]
    texts = {}
    for d in range(40):
        lines = [rng.choice([*pool, "", f"only {d}", f"here {rng.random()}"]) for _ in range(rng.randrange(12))]
        if d > 5 and rng.random() < 0.6:
            other = texts[rng.randrange(d)].split("\n")
            a = rng.randrange(len(other))
            lines[2:2] = other[a : a + rng.randrange(1, 8)]
        texts[d] = "\n".join(lines)
    assert got(make_docs(texts), least) == plain.repeated_lines(texts, least)


def test_rows(make_docs):
    """Text is rebuilt without the later copies; other texts and odd rows stay."""
    run = "\n".join(f"line {i} of a passage that more documents hold" for i in range(8))
    loop = "\n".join(["again and again"] * 40)
    pairs = [
        (1, f"first\n{run}\nend"), (2, f"{run}\n\nnew"), (3, run), (4, None), (5, ""), (6, " \n\n "),
        (7, "x" * 100_000 + "\n" + "y " * 60_000), (8, loop), (None, "no id"), (9, "same row"),
        (9, "same row"),
    ]
    docs = make_docs(pairs).withColumns({"doc": F.lit("clash"), "n_deleted": F.lit(7)})
    out = linedup.line_dedup(docs)
    rows = sorted(out.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    text = {r.doc_id: r.text for r in rows}
    assert text == dict(pairs) | {2: "\nnew", 3: "", 8: "again and again"}
    assert [r.doc for r in rows] == ["clash"] * len(pairs)
    assert {r.doc_id: r.n_deleted for r in rows if r.n_deleted} == {2: 8, 3: 8, 8: 39}
    kept = linedup.without_repeats(docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 9]
    assert {r.n_chars for r in kept.where("doc_id = 2").collect()} == {4}
    assert linedup.line_dedup(docs.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_words(make_docs):
    """Tabs part words, blanks of an indentation are none, characters count where blanks are not used."""
    tabs = "\t".join(f"cell{i}" for i in range(60))
    code = "\n".join(f"{' ' * 12}x{i} = y{i}" for i in range(5))
    han = "\u6587" * 60
    pairs = [(d, f"{d}\n{t}") for d, t in enumerate([tabs, tabs, code, code, han, han, "\t\n\t", "\t\n\t"])]
    docs = make_docs(pairs)
    assert got(docs, 50) == {1: [1], 5: [1]}
    kept = {r.doc_id: r.text for r in linedup.without_repeats(docs).collect()}
    assert kept == dict(pairs) | {1: "1", 5: "5"}


def test_registered_query(spark, tmp_path, make_docs):
    """Through the query and its SQL: a tab-separated copy goes, an indented one of few words stays."""
    import duckdb

    from liveops.llm.queries import ORACLES, QUERIES

    tabs = "\t".join(f"cell{i}" for i in range(60))
    code = "\n".join(f"{' ' * 12}x{i} = y{i}" for i in range(5))
    pairs = [(1, tabs), (2, f"{tabs}\nrest"), (3, code), (4, f"{code}\nend"), (5, "\u6587" * 50), (6, "\u6587" * 50)]
    make_docs(pairs).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.text, r.n_deleted) for r in QUERIES["op9_lines"](spark, str(tmp_path)).collect()}
    assert rows == {d: (t, 0) for d, t in pairs} | {2: ("rest", 1), 6: ("", 1)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = con.sql(f"SELECT doc_id, text, n_deleted FROM ({ORACLES['op9_lines']})").fetchall()
    assert {d: (t, n) for d, t, n in sql} == rows


def test_the_faster_pattern_has_the_same_words(spark):
    """Every character, between letters and beside blanks, counts as the plain pattern says."""
    codes = spark.range(0x110000).where("id < 55296 OR id > 57343")
    char = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    line = F.concat(F.lit("a"), char, F.lit("b "), char, char, F.lit("\tc"))
    rows = codes.select(
        linedup.native(line).alias("fast"), F.regexp_count(line, F.lit(linedup._WORD)).alias("plain")
    )
    assert linedup._FAST != linedup._WORD
    found = rows.agg(F.expr("count_if(fast <> plain)"), F.expr("count_if(plain > 3)")).first()
    assert found[0] == 0 and found[1] > 90_000
