"""Status documents as lines of any number."""

import json

from liveops.operators import fleet

ROWS = [
    (0, "b", 3), (0, 'a "quoted" \\ name', 1), (0, "ü\n", None), (1, "only", 7), (2, None, 1), (None, "x", 1), (0, "", 2),
]
SCHEMA = "server bigint, channel string, viewers bigint"


def documents(spark, df, path):
    fleet.write_status(df, path)
    found = {}
    for row in spark.read.schema("value string, server bigint").text(path, wholetext=True).collect():
        assert row.server not in found  # one file each
        found[row.server] = json.loads(row.value)
    return found


def test_documents(spark, tmp_path):
    got = documents(spark, spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "status"))
    names = ["", 'a "quoted" \\ name', "b", "ü\n"]
    assert got == {
        0: {"viewers": {"total": 6}, "channels": {
            "total": 4, "viewers": dict(zip(names, [2, 1, 3, 0])), "set": names}},
        1: {"viewers": {"total": 7}, "channels": {"total": 1, "viewers": {"only": 7}, "set": ["only"]}},
    }


def test_like_one_row(spark):
    df = spark.range(500).selectExpr("id % 3 AS server", "concat('c', id) AS channel", "id % 7 AS viewers")
    lines = fleet.status_lines(df).orderBy("server", "section", "channel").collect()
    for row in fleet.status_json(df).collect():
        assert "".join(r.line for r in lines if r.server == row.server) == row.doc


def test_empty(spark):
    assert fleet.status_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_channels(spark, tmp_path):
    df = spark.range(200_000).selectExpr("0L AS server", "concat('c', id) AS channel", "1L AS viewers")
    got = documents(spark, df, str(tmp_path / "many"))[0]
    assert got["viewers"]["total"] == len(got["channels"]["viewers"]) == len(got["channels"]["set"]) == 200_000
