"""Step functions of the batch folds as keyed streaming state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StructType

# The state functions need this provider on the session.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: When a row came in: the time of its micro-batch, never behind the watermark.
ARRIVED = "_arrived"
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _value(value, integral=False):
    """Plain Python value; missing cells become None."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    # pandas turns an integer column with gaps into floats.
    return int(value) if integral else value


def _read(value, kind):
    """A value of a state column in plain Python: structs as tuples."""
    if value is None:
        return None
    if isinstance(kind, ArrayType):
        return [_read(v, kind.elementType) for v in value]
    if isinstance(kind, StructType):
        return tuple(_read(v, f.dataType) for v, f in zip(value, kind.fields))
    return value


def _stored(value):
    """The way back; sets and queues are arrays."""
    if isinstance(value, tuple):
        return tuple(map(_stored, value))
    if isinstance(value, (list, set, frozenset)) or hasattr(value, "popleft"):
        return [_stored(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    return value


class Entries:
    """A map state as far as a step function needs a dict: an entry is read when it is asked for.

    What a micro-batch touches is held until ``flush``; the rest stays in the store.
    """

    def __init__(self, state, schemas: tuple[StructType, StructType]):
        self.state, self.values, self.changed = state, {}, set()
        self.key, self.value = schemas

    @staticmethod
    def _packed(value, schema):
        return value if len(schema.fields) > 1 else (value,)

    @staticmethod
    def _unpacked(value, schema):
        value = _read(value, schema)
        return value if value is None or len(schema.fields) > 1 else value[0]

    def get(self, key, default=None):
        if key not in self.values:
            found = self.state.getValue(self._packed(key, self.key))
            self.values[key] = self._unpacked(found, self.value)
        value = self.values[key]
        return default if value is None else value

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key):
        value = self.get(key)
        if value is None:
            raise KeyError(key)
        return value

    def __setitem__(self, key, value) -> None:
        self.values[key] = value
        self.changed.add(key)

    def pop(self, key, default=None):
        value = self.get(key, default)
        self[key] = None
        return value

    def items(self) -> Iterator[tuple]:
        """All entries, from the store one after the other."""
        self.flush()
        for key, value in self.state.iterator():
            yield self._unpacked(key, self.key), self._unpacked(value, self.value)

    def clear(self) -> None:
        self.state.clear()
        self.values, self.changed = {}, set()

    def flush(self) -> None:
        for key in self.changed:
            packed, value = self._packed(key, self.key), self.values[key]
            if value is None:
                self.state.removeKey(packed)
            else:
                self.state.updateValue(packed, self._packed(_stored(value), self.value))
        self.values, self.changed = {}, set()


class Machine(StatefulProcessor):
    """Runs ``step(state, row)`` over each key's rows of a micro-batch in order.

    The state is a dict: its fields of ``fields`` are columns of one value state, those of
    ``maps`` are map states, of which only the entries asked for are read. With ``patience_us``
    a timer goes off once nothing of a key has arrived for that long; ``finish(state)`` then
    returns output rows and the state to keep, if any.
    """

    def __init__(self, keys, order, begin, step, integral, out, fields, maps, finish=None,
                 patience_us=None):
        self.keys, self.order, self.begin = list(keys), list(order), begin
        self.step, self.integral, self.out = step, integral, out
        self.fields, self.maps = fields, maps
        self.finish, self.patience_us = finish, patience_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)
        self.entries = {n: handle.getMapState(n, *schemas) for n, schemas in self.maps.items()}

    def _load(self) -> dict:
        state = self.begin()
        if self.state.exists():
            for field, value in zip(self.fields.fields, self.state.get()):
                made, value = state[field.name], _read(value, field.dataType)
                # Lists become the set or queue that the state begins with.
                keep = made is None or value is None
                state[field.name] = value if keep else type(made)(value)
        return state | {n: Entries(self.entries[n], self.maps[n]) for n in self.maps}

    def _save(self, state: dict | None) -> None:
        if state is None:
            self.state.clear()
            for entries in self.entries.values():
                entries.clear()
            return
        self.state.update(tuple(_stored(state[f.name]) for f in self.fields.fields))
        for name in self.maps:
            state[name].flush()

    def _frame(self, key, rows: list[dict]) -> pd.DataFrame:
        plain_key = dict(zip(self.keys, map(_value, key)))
        rows = [plain_key | row for row in rows]
        return pd.DataFrame(
            {
                n: pd.array([r.get(n) for r in rows], dtype="Int64" if kind in INTEGRAL else object)
                for n, kind in self.out
            }
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        batch = pd.concat(list(rows)).sort_values(self.order)
        out = []
        columns = [(name, name in self.integral) for name in batch.columns]
        for values in batch.itertuples(index=False, name=None):
            row = {n: _value(v, whole) for (n, whole), v in zip(columns, values)}
            out.extend(self.step(state, row))
        self._save(state)
        if self.patience_us is not None:
            # The clock of the micro-batch, which is also the watermark of the next.
            at = timerValues.getCurrentProcessingTimeInMs() + self.patience_us // 1000
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            rows, state = self.finish(self._load())
            self._save(state)
            yield self._frame(key, rows)

    def close(self) -> None:
        pass


def stream_fold(stream: DataFrame, keys, order, begin: Callable[[], dict], step: Callable,
                schema: str, state: str, maps: dict[str, tuple[str, str]] | None = None,
                finish: Callable | None = None, patience_us: int | None = None) -> DataFrame:
    """Streaming twin of ``fold``: the same step, the state kept per key between batches.

    Rows of a micro-batch are taken in ``order``; across batches arrival decides.
    The rows of one key in one micro-batch must fit in memory: bound batches with
    ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``.

    ``state`` names the columns that hold the state's fields, ``maps`` the key and value columns
    of those fields that are maps of any size; a step asks for single entries of these.

    No row is dropped: each key goes by the times of its own rows, however far it is behind
    others. With ``patience_us``, ``finish(state)`` runs once nothing of a key has arrived for
    that long (by the clock of the micro-batches, which is the only watermark).
    """
    timed = patience_us is not None
    if timed:
        stream = stream.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, "0 seconds")
    struct = StructType.fromDDL(schema)
    integral = {n for n, kind in stream.dtypes if kind in INTEGRAL}
    out = [(f.name, f.dataType.simpleString()) for f in struct.fields]
    return stream.groupBy(*keys).transformWithStateInPandas(
        Machine(
            keys, order, begin, step, integral, out, StructType.fromDDL(state),
            {n: tuple(map(StructType.fromDDL, kv)) for n, kv in (maps or {}).items()},
            finish, patience_us,
        ),
        struct, "Append", "EventTime" if timed else "None",
    )
