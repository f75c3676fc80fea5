"""Order-dependent state machines per key as a bounded-memory stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(
    df: DataFrame,
    keys,
    order,
    begin: Callable[[], dict],
    step: Callable[[dict, dict], list[dict]],
    schema: str,
    finish: Callable[[dict], list[dict]] | None = None,
) -> DataFrame:
    """Run ``step(state, row)`` over each key's rows in order; it returns output rows.

    Spark shuffles by key and sorts; a task holds one Arrow batch and one state
    at a time, so a long key never has to fit in memory. Split long keys before
    at rows where the state is known to start afresh.
    """
    keys, order = list(keys), list(order)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    names = [f.name for f in struct.fields]

    def run(batches):
        current, state, out = None, None, []

        def table():
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], arrow)

        def keyed(rows):
            return [dict(zip(keys, current)) | row for row in rows]

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != current:
                    if state is not None and finish:
                        out.extend(keyed(finish(state)))
                    current, state = key, begin()
                out.extend(keyed(step(state, row)))
            if out:
                yield table()
                out.clear()
        if state is not None and finish:
            out.extend(keyed(finish(state)))
        if out:
            yield table()

    return (
        df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, struct)
    )
