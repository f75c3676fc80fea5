from pyspark.sql import functions as F

from liveops.llm import decontam

ITEM = (
    "In March Alice bought 12 apples for 30 cents each and gave 12 of them to Bob, so how much "
    "did Alice spend on the apples she kept that week?"
)
SHORT = "what is the capital of france"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(docs, bench):
    return {(r.doc_id, r.item_id): r for r in decontam.find(docs, bench).collect()}


def test_kinds(spark, make_docs):
    """Exact, re-punctuated and re-parameterised copies are found; clashing slots and parts not."""
    changed = ITEM.replace("12", "7").replace("Alice", "Carol").replace("cents", "euros")
    clash = ITEM.replace("gave 12", "gave 99").replace("did Alice", "did Peter")
    docs = make_docs({
        1: f"Some words. {ITEM} More words.", 2: "x " + ITEM.lower().replace(",", " -"),
        3: f"Some words. {changed} More.", 4: f"Some words. {clash}", 5: " ".join(ITEM.split()[:9]),
        6: f"so {SHORT}?", 7: "the capital of france is what", 8: None, 9: "", 10: "12 13 14 " * 5000,
    })
    got = found(docs, items(spark, [(1, ITEM), (2, SHORT), (3, None), (4, ""), (None, ITEM)]))
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 2)}
    assert got[1, 1].exact and got[1, 1].covered == got[1, 1].item_words == 30
    assert got[2, 1].exact and got[6, 2].covered == 6
    assert {(s.in_item, s.in_doc) for s in got[3, 1].slots} == {
        ("12", "7"), ("alice", "carol"), ("cents", "euros"),
    }
    assert not got[3, 1].exact and got[3, 1].covered == 30
    # Slots that clash count for nothing; only the words as they stand do.
    assert got[4, 1].exact and got[4, 1].slots == [] and got[4, 1].covered < 30


def test_clash_alone(spark, make_docs):
    """A template whose slots do not agree is no copy."""
    bench = items(spark, [(1, "add 3 to 4 and then 3 to 5 and take 4 from 5 to get 3 or 4 less than 5")])
    other = "add 8 to 9 and then 8 to 7 and take 9 from 7 to get 8 or 9 less than 7"
    wrong = "add 8 to 9 and then 1 to 7 and take 2 from 6 to get 5 or 9 less than 3"
    assert set(found(make_docs({1: other, 2: wrong}), bench)) == {(1, 1)}


def test_openers(spark, make_docs):
    """Names that open sentences are slots; what stands before an item makes no difference."""
    bench = items(spark, [
        (1, "Tom has 5 apples. Mary has 3 pears. How many pears do they have?"),
        (2, "Add pears to plums. Tom eats 5 of them and keeps the rest for later"),
    ])
    other = "Ann has 7 apples. Bob has 4 pears. How many pears do they have?"
    docs = make_docs({
        1: other, 2: f"Question: {other}", 3: f"A heading\n{other}", 4: f'He said "{other}"',
        5: f"then {other.replace('How', 'how')}", 6: "What is here",
        7: "so add pears to plums. Ann eats 6 of them and keeps the rest for later",
    })
    got = found(docs, bench)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 2)}
    assert all(r.covered >= 13 for r in got.values())
    assert {(s.in_item, s.in_doc) for s in got[3, 1].slots} >= {("mary", "bob"), ("3", "4")}
    assert ("tom", "ann") in {(s.in_item, s.in_doc) for s in got[7, 2].slots}


def test_function_words(spark, make_docs):
    """A question word that opens an item is no name."""
    bench = items(spark, [(1, "What is the capital of France?")])
    docs = make_docs({1: "Paris is the capital of France.", 2: "What is the capital of Spain?"})
    assert set(found(docs, bench)) == {(2, 1)}


def test_clash_in_part(spark, make_docs):
    """Different values may become equal, and a clash costs only the windows that hold it."""
    long = (
        "a farm has 12 cows and 30 hens and the owner wants to sell 7 of the cows at noon "
        "but later the trader with 2 trains waits for 2 hours before the rest of the herd of the farm is sold"
    )
    bench = items(spark, [
        (1, "that day the boy had 5 apples and 3 pears in a bag and ate them all"), (2, long),
    ])
    docs = make_docs({
        1: "that day the boy had 4 apples and 4 pears in a bag and ate them all",
        2: long.replace("12", "8").replace("30", "9").replace("2 trains", "4 trains").replace("2 hours", "6 hours"),
    })
    got = found(docs, bench)
    assert set(got) == {(1, 1), (2, 2)}
    assert got[1, 1].covered == 17 and [tuple(s) for s in got[1, 1].slots] == [("3", "4"), ("5", "4")]
    assert not got[2, 2].exact and 28 <= got[2, 2].covered < got[2, 2].item_words
    assert {tuple(s) for s in got[2, 2].slots} >= {("12", "8"), ("30", "9")}


def test_dense(spark, make_docs):
    """Short items, and items dense in numbers in the middle and at their end, are templates too."""
    bench = items(spark, [
        (1, "What is 12 plus 7?"), (2, "from 3 to 4 and then 3 to 5"),
        (3, "take the sum of 3 4 5 6 7 8 9 and then divide it by the first one"),
        (4, "please add up these numbers 1 2 3 4 5 6 7 8 9"), (5, "12 and 7"), (6, "1 2 3 4 5 6 7 8 9"),
        (7, "compare Ann Bob Cid Dan Eve Fay Gus Hal by their age"),
    ])
    docs = make_docs({
        1: "So what is 40 plus 2? Yes.", 2: "x from 8 to 9 and then 8 to 7 x",
        3: "x take the sum of 9 8 7 6 5 4 3 and then divide it by the first one x",
        4: "x please add up these numbers 9 8 7 6 5 4 3 2 1 x", 5: "1 2 " * 5000, 6: "9 and 8",
        7: "compare Ida Jim Kit Lea Max Ned Oda Pam by their age",
        8: "take the sum of 9 8 7 6 5 4 3 2 and then", 9: "what is 12 minus 7?",
    })
    got = found(docs, bench)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (7, 7)}
    assert all(r.covered == r.item_words for r in got.values())


def test_tables(spark, folder):
    """Every document that holds an item's whole text is found, and no other of the tables."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    texts, asked = docs.collect(), bench.collect()
    want = {(d.doc_id, b.item_id) for d in texts for b in asked if b.text in d.text}
    assert set(found(docs, bench)) == want


def test_rows(spark, make_docs):
    docs = make_docs([(1, ITEM), (1, ITEM), (None, ITEM), (2, "clean")])
    docs = docs.withColumns({"item_id": F.lit("clash"), "window": F.lit(1)})
    bench = items(spark, [(1, ITEM), (1, ITEM), (2, ITEM)])
    assert sorted(found(docs, bench)) == [(1, 1), (1, 2)]
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]
    assert decontam.find(docs, bench.limit(0)).count() == 0
    assert decontam.find(docs.limit(0), bench).count() == 0
