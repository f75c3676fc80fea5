"""Rule tables by joins against the same rules as expressions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from liveops.operators import rule_tables, rules
from liveops.operators.rules import Rule
from liveops.operators.rule_tables import required


@pytest.mark.parametrize("pattern, literals", [
    ("firefox", ["firefox"]), ("^mplayer[0-9]+$", ["mplayer"]), ("a.*browser|music", ["browser", "music"]),
    ("colou?r", ["colo"]), ("abcd{0,2}ef", ["abc"]), (r"a\.b\+c", ["a.b+c"]), ("abc+d", ["abc"]),
    (r"abcdef[\[]x|foo", ["abcdef", "foo"]), (r"abcdef[\]|]x", ["abcdef"]), ("abcdef[]|]x", ["abcdef"]),
    ("(abc|def)ghi", ["ghi"]), ("(?:abc(d|e))*wxyz", ["wxyz"]), ("(?i)abcdef", None), ("ab", None),
    ("abc|de", None), ("", None), (r"abc\Qd|e\E", None), (r"(abc)\12", None), ("[0-9]{3}", None),
    ("abc{2}|def", None), ("[a&&b]cdef", None), ("[abc", None), (r"abc\d\bxyzw", ["xyzw"]),
    ("über.*straße", ["straße"]), (None, None),
])
def test_required(pattern, literals):
    assert required(pattern) == literals


PIECES = st.sampled_from(
    ["abc", "xyzw", "d", "[a-c]", "[^d]", "(ab|c)", "(?:xy)?", ".", "|", "a*", "b+", "c?", r"\.", r"\w", "z{2}"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=6).map("".join), st.text("abcdxyzw.", max_size=20))
def test_a_match_holds_a_literal(pattern, text):
    literals = required(pattern)
    if literals and re.search(pattern, text):
        assert any(literal in text for literal in literals)


LISTED = [
    Rule("stream", level=5), Rule("[0-9]{2}", level=7), Rule("music|video", props={"role": "media"}),
    Rule("video.*on", props={"role": "screen", "x": "1"}, mode="merge"), Rule("^über", level=9),
    Rule("only", props={"k": "v"}, mode="set"), Rule("ding|dong(a|b)", level=11), Rule("", props={"any": "1"}),
    Rule("stream", props={"twice": "yes"}), Rule("nothing here", level=99),
]
TEXTS = [
    "a music stream", "video 12 stays on", "über stream 77", "only video on", "", None, "ding", "dongb music",
    "a music stream", "x" * 50_000 + " stream", "vide", "𝄞𝄞 only 𝄞",
]


def test_like_expressions(spark):
    rows = [(i, i % 3 or None, t, 1, {"old": "o"} if i % 4 else None, "extra") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(
        rows, "id long, part long, text string, level long, props map<string,string>, pattern string"
    )
    want = rules.apply(df, LISTED, "text", props="props")
    got = rule_tables.apply(df, rule_tables.table(spark, LISTED), "text", ["part", "id"], props="props")
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc", 3)], "id long, text string, level long")
    none = rule_tables.table(spark, [])
    assert rule_tables.apply(df, none, "text", ["id"]).collect() == df.collect()
    full = rule_tables.table(spark, LISTED)
    assert rule_tables.apply(df.limit(0), full, "text", ["id"]).count() == 0
    nulls = spark.createDataFrame([(1, None, 5, None, None)], rule_tables.SCHEMA)
    assert rule_tables.apply(df, nulls, "text", ["id"]).collect() == df.collect()


def test_many_rules(spark):
    """The plan does not grow with the rules."""
    listed = spark.range(10_000).selectExpr(
        "id AS rule", "concat('word', id, 'x') AS pattern", "id AS level",
        "CAST(NULL AS map<string,string>) AS props", "'replace' AS mode",
    )
    df = spark.range(2_000).selectExpr("id", "concat('a word', id * 3, 'x word', id, 'x b') AS text", "-1L AS level")
    got = rule_tables.apply(df, listed, "text", ["id"])
    assert len(got._jdf.queryExecution().toString()) < 100_000
    rows = got.selectExpr("count_if(level = least(id * 3, 9999) OR level = id) AS good", "count(*) AS n").first()
    assert (rows.good, rows.n) == (2_000, 2_000)


@pytest.mark.parametrize("pattern, runs", [
    ("Se[^A-Za-z]+que", ["Se#que"]), (r"Se\s+la|foo +bar", ["Se#la", "foo#bar"]), ("ax[^a-zA-Z0-9]b", ["ax#b"]),
    (r"ab\W*cd", None), ("ab[^a-z]+cd", None), ("ab[^A-Za-z]?cd", None), ("ab(?: )cd", None), ("ab+cd", None),
    ("[^A-Za-z]+abc[0-9]", None), (r"ab\S+cd", None), ("ab[^A-Za-z]+?cd", None), ("ab[ _x]cd", None),
])
def test_keys_with_gaps(pattern, runs):
    """Words too short for a literal are keys together with the gap between them."""
    found = rule_tables.keys(pattern)
    kinds = {k >> rule_tables.KIND for branch in found or [] for k in branch}
    assert (min(kinds, default=0) > rule_tables.SPANNING) == (runs is not None)
    for branch, run in zip(found or [], runs or []):
        assert all((k & (1 << 56) - 1).to_bytes(7).lstrip(b"\0").decode() in run for k in branch)


WORDS = st.text("abzAZ 1-\t\u00fc\U0001d11e", max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=6), st.sampled_from([1, 3, 8, 1 << 17]))
def test_grams_of_texts(texts, size):
    """Those of each text by itself, wherever pieces and batches of it are cut."""
    known, kinds = np.ones(1 << rule_tables.BITS, bool), {6, 4, 3, 15, 13, 12}
    want = set()
    for i, text in enumerate(texts):
        for spanning, sizes in enumerate((rule_tables.GRAMS, rule_tables.GAPPED)):
            data = (re.sub(b"[^A-Za-z]+", b"#", text.encode()) if spanning else text.encode())
            for n in sizes:
                cut = np.frombuffer(data, np.uint8)
                want |= {(i, k) for k in rule_tables._keyed(cut, n, bool(spanning)).tolist()}
    before, rule_tables.SLICE = rule_tables.SLICE, size
    try:
        column = pa.array(["left out", *texts, "left out"], pa.string())[1:-1]
        got = [pair for row, gram in rule_tables._met(column, known, kinds) for pair in zip(row.tolist(), gram.tolist())]
    finally:
        rule_tables.SLICE = before
    assert set(got) == want


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from(["ab", "Xyz", r"\s+", "[^A-Za-z]+", "[^a-zA-Z_]", " +", r"\W", "-", "|", "c?"]), max_size=6).map("".join),
    st.text("abcXyz -_1", max_size=20),
)
def test_a_match_holds_a_key(pattern, text):
    found = rule_tables.keys(pattern)
    if found and re.search(pattern, text, re.ASCII):
        every = {*rule_tables.GRAMS, *(n + rule_tables.SPANNING for n in rule_tables.GAPPED)}
        known = np.ones(1 << rule_tables.BITS, bool)
        met = {g for _, grams in rule_tables._met(pa.array([text]), known, every) for g in grams.tolist()}
        assert any(set(branch) <= met for branch in found)


def test_gaps_like_expressions(spark):
    listed = [
        Rule(r"Se\s+la", level=1), Rule("de[^A-Za-z]+in", level=2), Rule("de +in|x-y", props={"a": "b"}),
        Rule(r"music\W+on", level=4), Rule("\ufffdabc", level=5), Rule("o[^A-Za-z]+p", level=6),
    ]
    texts = ["Se la", "Se\n\n la", "Sela", "de 12 - \u00fc in", "den in", "x-y", "music" + " " * 300_000 + "on", "o 7p", "music", " on"]
    df = spark.createDataFrame([(i, t, 0, {}) for i, t in enumerate(texts)], "id long, text string, level long, props map<string,string>")
    got = rule_tables.apply(df, rule_tables.table(spark, listed), "text", ["id"], props="props")
    want = rules.apply(df, listed, "text", props="props")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
