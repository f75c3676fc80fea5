import pathlib

import plain
import pytest
import test_packing

import corpus_pipeline


@pytest.fixture(scope="module")
def staged(spark, folder, tmp_path_factory):
    """What each stage gets and returns, over the whole documents."""
    place = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{place}/{name}")
        after = spark.read.parquet(f"{place}/{name}")
        out.append((docs, after))
        docs = after
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(staged, spark, folder):
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    for name, (_, after) in list(staged.items())[:-1]:
        assert after.dtypes == whole.dtypes, name


def test_language(staged):
    before, after = staged["language"]
    assert texts(after) == {d: t for d, t in texts(before).items() if any(c.isalpha() for c in t)}


def test_line_dedup(staged):
    before, after = (texts(x) for x in staged["line_dedup"])
    gone = plain.repeated_lines(before, 50)
    want = {}
    for d, t in before.items():
        lines = t.split("\n")
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone.get(d, ()))
        if d not in gone or left.strip(" \n"):
            want[d] = left
    assert after == want and gone


def test_near_dedup(staged):
    before, after = (texts(x) for x in staged["near_dedup"])
    groups = plain.near_duplicates(before)
    assert after == {d: before[d] for d, (_, least) in groups.items() if least == d}


def test_decontamination(staged, spark, folder):
    before, after = (texts(x) for x in staged["decontamination"])
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert after == {d: t for d, t in before.items() if not any(x in t for x in items)}


def test_packing_and_run(staged, spark, folder):
    before, after = staged["packing"]
    test_packing.verify(after.collect(), [(r.doc_id, r.text) for r in before.collect()])
    again = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert again.select(key).exceptAll(after.select(key)).count() == 0
    assert again.count() == after.count()


def test_guard():
    """Nothing else in the library imports this part."""
    top = pathlib.Path(corpus_pipeline.__file__).parent / "liveops"
    for path in top.rglob("*.py"):
        if "llm" not in path.relative_to(top).parts:
            assert "liveops.llm" not in path.read_text(), path
