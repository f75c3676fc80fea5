"""Telecast catalog: find, page, members, change."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liveops.operators import keyed
from liveops.operators.numbered import numbered

SCHEMA = (
    "ID bigint, uid bigint, name string, title string, introduce string, live_name string, "
    "live_desc string, start_time bigint, end_time bigint, category int, department int, "
    "public int, hot bigint, praises bigint, hits bigint, channel string, status int, "
    "create_time bigint"
)
# Statuses whose member lists are hidden, by the asking script.
HIDDEN_FROM_MEMBERS = (2,)
HIDDEN_FROM_DELETE = (3,)
SORTS = ("hits", "hot", "create_time")


def scan(spark: SparkSession, source: str | dict) -> DataFrame:
    """Catalog rows from a parquet path, or from JDBC given as reader options.

    For JDBC pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` so that the read is split.
    """
    if isinstance(source, dict):
        return spark.read.format("jdbc").options(**source).load()
    return spark.read.schema(SCHEMA).parquet(source)


def append(new: DataFrame, known: DataFrame, order) -> DataFrame:
    """New rows with ids after the greatest known one, ready to be written in append mode."""
    last = known.agg(F.coalesce(F.max("ID"), F.lit(0))).scalar()
    return numbered(new, order, "_n").withColumn("ID", F.col("_n") + last + 1).drop("_n")


def project(df: DataFrame) -> DataFrame:
    return df.select(F.col("ID").alias("live_ID"), *[c for c in df.columns if c != "ID"])


def find(df: DataFrame, **equal) -> DataFrame:
    """Rows equal in every given column; a None is no filter."""
    tests = [F.col(name) == value for name, value in equal.items() if value is not None]
    return df.where(reduce(and_, tests)) if tests else df


def page(df: DataFrame, sort: str, index: int, count: int, descending: bool = False) -> DataFrame:
    """``count`` rows from ``index`` in order of ``sort``, ties by ID."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    by = F.col(sort).desc() if descending else F.col(sort).asc()
    return df.orderBy(by, F.col("ID").asc()).offset(index).limit(count)


def members(catalog: DataFrame, invitees: DataFrame, hidden=HIDDEN_FROM_MEMBERS) -> DataFrame:
    """Invitees of the telecasts whose status does not hide them."""
    shown = catalog.where(~F.col("status").isin(*hidden)).select(F.col("ID").alias("grpID"))
    return invitees.join(shown, "grpID", "left_semi")


def invited(catalog: DataFrame, invitees: DataFrame, uid: int | None = None) -> DataFrame:
    """Telecasts to which a user, or anyone, is invited."""
    asked = invitees if uid is None else invitees.where(F.col("memberID") == uid)
    return catalog.join(asked, catalog["ID"] == asked["grpID"], "left_semi")


def remove(catalog: DataFrame, invitees: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog and invitees without the telecasts in ``ids.ID``."""
    return (
        catalog.join(ids, "ID", "left_anti"),
        invitees.join(ids.withColumnRenamed("ID", "grpID"), "grpID", "left_anti"),
    )


def patch(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Catalog with the non-null fields of ``changes`` (one row per ID) put in."""
    fields = [c for c in changes.columns if c != "ID"]
    new = changes.select("ID", *[F.col(c).alias(f"_new_{c}") for c in fields])
    return catalog.join(new, "ID", "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in catalog.columns]
    )


def module_version(df: DataFrame, kind, allowed, order: str) -> DataFrame:
    """First row of each asked kind, of the kinds allowed."""
    wanted = [k for k in kind if k in allowed]
    return keyed.first(df.where(F.col("type").isin(wanted)), "type", order)
