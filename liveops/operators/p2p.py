"""Client directory: who is registered, who owns which resource."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.operators import keyed
from liveops.operators.ordered import latest, ordered

OK, NOT_FOUND = 200, 404


def register(new: DataFrame, known: DataFrame, key: str, order) -> DataFrame:
    """Rows to insert: the first of each key not known yet."""
    return keyed.first(new.join(known.select(key), key, "left_anti"), key, order)


def orphan_resources(resources: DataFrame, clients: DataFrame) -> DataFrame:
    """Resources whose owner is not registered any more."""
    return resources.join(
        clients.select(F.col("client").alias("owner")), "owner", "left_anti"
    )


def lookup(requests: DataFrame, clients: DataFrame, resources: DataFrame) -> DataFrame:
    """Reply to each query: 200 with the owner, 404, or null for a client that must ping first."""
    here = clients.select("client", F.lit(True).alias("_here"))
    owners = resources.select("resource", "owner")
    found = requests.join(here, "client", "left").join(owners, "resource", "left")
    return found.select(
        *requests.columns,
        F.when(F.col("_here"), F.when(F.col("owner").isNotNull(), OK).otherwise(NOT_FOUND)).alias(
            "reply"
        ),
        F.when(F.col("_here"), F.col("owner")).alias("owner"),
    )


def directory(requests: DataFrame, order=("us", "event_id")) -> DataFrame:
    """Replay PING, COMMIT, QUERY, TRANSFER and QUIT; replies as in ``lookup``.

    The first commit of a resource by a registered client owns it for good, also
    after the owner quit.
    """
    action = F.col("action")
    seen = ordered(requests, ["client"], order).running(
        _in=latest(F.when(action == "PING", True).when(action == "QUIT", False), inclusive=False)
    )
    rows = seen.map({"_in": F.coalesce("_in", F.lit(False))}).result()
    commits = rows.where((action == "COMMIT") & F.col("_in"))
    owners = keyed.first(
        commits.select("resource", F.col("client").alias("owner"), *order), "resource", order
    ).select("resource", "owner", *[F.col(c).alias(f"_{c}") for c in order])
    joined = rows.join(owners, "resource", "left")
    owned = F.struct(*[f"_{c}" for c in order]) < F.struct(*order)
    there = F.col("owner").isNotNull() & owned
    asks = action.isin("QUERY", "TRANSFER")
    return joined.select(
        *requests.columns,
        F.when(action == "PING", OK)
        .when(~F.col("_in"), None)
        .when(asks & ~there, NOT_FOUND)
        .otherwise(OK)
        .alias("reply"),
        F.when(F.col("_in") & asks & there, F.col("owner")).alias("owner"),
    )
