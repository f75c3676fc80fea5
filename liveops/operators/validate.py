"""Required fields: accepted rows, and rejected ones with a reason code."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the reply code for a missing or malformed argument.
BAD_ARGUMENT = 10004


def marked(df: DataFrame, required) -> DataFrame:
    """``reject_code`` is null for a row with every required field."""
    missing = reduce(or_, [F.col(c).isNull() for c in required])
    return df.withColumn("reject_code", F.when(missing, BAD_ARGUMENT))


def split(df: DataFrame, required) -> tuple[DataFrame, DataFrame]:
    rows = marked(df, required)
    bad = F.col("reject_code").isNotNull()
    return rows.where(~bad).drop("reject_code"), rows.where(bad)


def parsed(df: DataFrame, body: str, schema: str) -> DataFrame:
    """JSON ``body`` as columns; text that is no JSON is kept in ``_corrupt``."""
    doc = F.from_json(
        body, f"{schema}, _corrupt string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, doc.alias("_doc")).select(*rest, "_doc.*")
