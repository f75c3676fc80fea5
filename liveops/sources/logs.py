"""Server logs, access logs and configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liveops.operators.ordered import latest, ordered

# Fixed patterns: both server logs write time, module, level and message; the
# access log has eleven fields.
SERVER_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) :  *(\S+) *: (\S+) *: (.*)$"
ACCESS_LINE = (
    r'^\[([^\]]*)\] (\S+) (\S+) (\d+) (\d+) (\S+) (\S+)\s+(\S+) "([^"]*)" "([^"]*)" "(.*)"$'
)
ERRNO = r"^errno = (\d+) \((.*)\)$"
ACCESS_FIELDS = (
    "time", "request_time", "addr", "status", "bytes", "method", "url", "referer", "agent",
    "cookie", "body",
)
# Levels of the streaming server and of the file server, most severe first.
STREAM_LEVELS = ("_ERROR_", "_INFO_", "_INFOV_", "_DEBUG_", "_DEBUGV_")
FILE_LEVELS = ("_COMPLAIN_", "_PEACE_", "_HAPPY_")


def _parts(line: Column, pattern: str, names) -> list[Column]:
    return [F.regexp_extract(line, pattern, i + 1).alias(n) for i, n in enumerate(names)]


def server_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Columns ts, module, level, msg and, on errno lines, errno of server log lines.

    Lines of another form are kept with null ``ts`` and the text in ``msg``.
    """
    rest = [c for c in df.columns if c != line]
    ok = F.col(line).rlike(SERVER_LINE)
    stamp, module, level, msg = _parts(F.col(line), SERVER_LINE, ("ts", "module", "level", "msg"))
    return df.select(
        *rest,
        F.when(ok, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts"),
        F.when(ok, module).alias("module"),
        F.when(ok, level).alias("level"),
        F.when(ok, msg).otherwise(F.col(line)).alias("msg"),
        F.when(ok, F.regexp_extract(msg, ERRNO, 1).try_cast("int")).alias("errno"),
    )


def server(spark: SparkSession, path: str) -> DataFrame:
    return server_lines(spark.read.text(path).withColumn("file", F.input_file_name()))


def at_most(df: DataFrame, level: str, levels=STREAM_LEVELS) -> DataFrame:
    """Rows at ``level`` or more severe."""
    return df.where(F.col("level").isin(*levels[: levels.index(level) + 1]))


def access_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Access log lines in eleven columns; one of another form has its text in ``rejected``."""
    rest = [c for c in df.columns if c != line]
    fits = F.coalesce(F.col(line).rlike(ACCESS_LINE), F.lit(False))
    fields = _parts(F.when(fits, F.col(line)), ACCESS_LINE, ACCESS_FIELDS)
    rows = df.select(*rest, *fields, F.when(~fits, F.col(line)).alias("rejected"))
    return rows.withColumns(
        {
            "time": F.try_to_timestamp("time", F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
            "request_time": F.col("request_time").try_cast("double"),
            "status": F.col("status").try_cast("int"),
            "bytes": F.col("bytes").try_cast("bigint"),
        }
    )


def access(spark: SparkSession, path: str) -> DataFrame:
    return access_lines(spark.read.text(path))


def ini_settings(files: DataFrame) -> DataFrame:
    """Settings (file, section, key, value) of config files given as (file, value).

    A section header holds for the lines after it, blank lines and # comments
    are skipped, and the first of a repeated key stays.
    """
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    lines = lines.where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    head = F.trim(F.regexp_extract("line", r"^\s*\[([^\]]*)\]", 1))
    rows = ordered(lines.withColumn("head", head), ["file"], ["pos"]).running(
        section=latest(F.when(F.col("head") != "", F.col("head")))
    )
    pairs = rows.df.where((F.col("head") == "") & F.col("line").contains("=")).select(
        "file", "section", "pos",
        F.trim(F.substring_index("line", "=", 1)).alias("key"),
        F.trim(F.regexp_replace("line", r"^[^=]*=", "")).alias("value"),
    )
    return pairs.groupBy("file", "section", "key").agg(F.min_by("value", "pos").alias("value"))


def ini_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Settings of many hosts' config files, each read whole."""
    files = spark.read.text(path, wholetext=True)
    return ini_settings(files.withColumn("file", F.input_file_name()))
