"""State machines over keys of any size: blocks of a key's rows run in parallel, with equal results.

Rows are cut into parts of like size by splitters over (keys, order), scalar subqueries, so no job
runs while a plan is built. A key whose rows lie in one part is folded as it is. Only a key that
reaches over a splitter is shared, and there are no more of these than splitters: its rows in one
part are a block. What a block does depends on the state it is entered with, which is found
without running the blocks one after another:

* ``composed``: a block is summarised as a map from entry states to exit states. It runs from all
  states that could enter it; those that lead to the same state are one from then on. States with
  an unbounded value stay one open class until a row tells them apart. The maps of a key's blocks
  are chained, one small row each, and the blocks replayed from their true entries.
* ``coupled``: for states too many to map. A block is run from the beginning state, and its exit is
  taken as the next block's entry; each block is then run again from that. If both runs of a block
  end alike, the second one's entry was true whenever the block before it was, and so by induction
  all are true up to the first block whose runs end differently. What comes after that one is
  replayed in order from its exit, so a machine that never forgets costs time, not results.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liveops.operators.fold import fold
from liveops.operators.numbered import part_count, place, splitters


class Machine(Protocol):
    """A state machine; ``freeze`` makes a value of JSON of a state, ``thaw`` a state of it."""

    def begin(self) -> dict: ...

    def step(self, state: dict, row: dict) -> list[dict]: ...

    def finish(self, state: dict) -> list[dict]: ...

    def freeze(self, state: dict): ...

    def thaw(self, frozen) -> dict: ...


class Mapped(Machine, Protocol):
    """A machine whose entry states fall into classes.

    A class is a value of JSON. ``known`` are the states that are classes of their own. ``before``
    and ``after`` tell which entry states of the open classes a row makes definite, with the state
    they are in before or after the row; ``opened`` is a memory of a block. A state belongs to the
    first class that it ``matches``, or else has not changed.
    """

    def known(self) -> list: ...

    def before(self, opened: dict, row: dict) -> list[tuple]: ...

    def after(self, opened: dict, row: dict) -> list[tuple]: ...

    def matches(self, kind, frozen) -> bool: ...


@dataclass(frozen=True)
class Steps:
    """A machine of plain functions."""

    begin: Callable[[], dict]
    step: Callable[[dict, dict], list[dict]]
    freeze: Callable
    thaw: Callable
    finish: Callable[[dict], list[dict]] = lambda state: []


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]


def _block(keys: list[str]) -> list[Column]:
    """The block of a row; null-safe, since a filter for nulls would move under the exchange."""
    return [*_same(keys), F.col("_part").eqNullSafe(F.col("_at"))]


def _above(condition: Column) -> Column:
    """``condition``, which stays above the exchange below it.

    Moved under it, it would make the exchange another one, and all before it would run again.
    """
    return F.when(F.monotonically_increasing_id() >= 0, condition)


def _named(df: DataFrame, keys: list[str], *rest) -> DataFrame:
    """Keys renamed, so that null keys can be matched too."""
    return df.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], *rest)


def _split(df: DataFrame, keys, order, along=None) -> tuple[DataFrame, DataFrame]:
    """Rows of keys in one part, and those of keys in several with ``_part`` and ``_last``."""
    rows, columns = along or (df, [*keys, *order])
    parts = part_count(df)
    cut = df.withColumn("_cuts", splitters(rows, columns, parts))
    # One exchange, which all that is made of the parts reads again.
    placed = cut.withColumn("_part", place(columns, parts)).drop("_cuts").repartition(*keys, "_part")
    # Of whole rows: with fewer columns it would be another exchange.
    spans = placed.groupBy(*keys).agg(
        F.min("_part").alias("_low"), F.max_by(F.struct(*placed.columns), "_part").alias("_high")
    ).withColumn("_last", F.col("_high._part"))
    # Each of them holds a splitter: at most as many rows as parts.
    spans = F.broadcast(_named(spans.where("_low < _last"), keys, "_last"))
    small = placed.join(spans, _same(keys), "left_anti").drop("_part")
    return small, placed.join(spans, _same(keys)).drop(*[f"_s{i}" for i in range(len(keys))])


def _typed(df: DataFrame, names: list[str], schema: str, *more: str) -> str:
    """``schema`` with the columns ``names`` of ``df`` that it lacks, and more."""
    own = {part.split()[0] for part in schema.split(",")}
    added = [f"{n} {df.schema[n].dataType.simpleString()}" for n in names if n not in own]
    return ", ".join([*added, schema, *more])


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def _from(machine: Machine, last: bool):
    """``begin``, ``step`` and ``finish`` of a fold whose rows carry the entry state."""

    def begin():
        return {"state": None, "row": None}

    def step(held, row):
        if held["state"] is None:
            entry = row["_entry"]
            held["state"] = machine.begin() if entry is None else machine.thaw(json.loads(entry))
        held["row"] = row
        return machine.step(held["state"], row)

    def finish(held):
        row, frozen = held["row"], json.dumps(machine.freeze(held["state"]))
        out = machine.finish(held["state"]) if last or row["_part"] == row["_last"] else []
        return [*out, {"_exit": frozen, "_wrong": row.get("_guess", frozen) != frozen}]

    return begin, step, finish


def _replayed(rows: DataFrame, keys, order, machine, schema, last=False) -> DataFrame:
    """Rows with their block's ``_entry`` to output, and a row with the ``_exit`` of each block.

    That row is ``_wrong`` if the rows have a ``_guess`` that is not the exit.
    """
    block = list(keys) if last else [*keys, "_part"]
    begin, step, finish = _from(machine, last)
    made = _typed(rows, block, schema, "_exit string", "_wrong boolean")
    return fold(rows, block, order, begin, step, made, finish)


def _small(rows: DataFrame, keys, order, machine, schema) -> DataFrame:
    return fold(rows, keys, order, machine.begin, machine.step, schema, machine.finish)


def composed(df: DataFrame, keys, order, machine: Mapped, schema: str) -> DataFrame:
    """Fold ``df`` by ``machine``, blocks of a key in parallel by their maps of entry states."""
    keys, order = list(keys), list(order)
    small, large = _split(df, keys, order)
    at = _typed(large, [*keys, "_part"], "_class string, _exit string, _rank bigint")
    maps = fold(
        large, [*keys, "_part"], order, lambda: _race(machine), _race_step(machine), at, _race_finish(machine)
    )
    entries = fold(
        maps, keys, ["_part", "_rank"], _walk(machine), _walk_step(machine),
        _typed(large, keys, "_part int, _entry string"),
    )
    entries = _named(entries.withColumnRenamed("_part", "_at"), keys, "_at", "_entry")
    entered = large.join(entries, _block(keys))
    out = _replayed(entered, keys, order, machine, schema).where("_exit IS NULL").select(*_names(schema))
    return _small(small, keys, order, machine, schema).unionByName(out)


def _race(machine: Mapped) -> dict:
    """Runs by state: the ranks of the classes that are in it; and the classes themselves."""
    runs, classes = {}, []
    for frozen in machine.known():
        runs.setdefault(json.dumps(frozen), []).append(len(classes))
        classes.append({"is": frozen})
    return {"runs": runs, "classes": classes, "opened": {}}


def _race_step(machine: Mapped) -> Callable:
    def step(race: dict, row: dict) -> list[dict]:
        def join(found):
            for kind, frozen in found:
                race["runs"].setdefault(json.dumps(frozen), []).append(len(race["classes"]))
                race["classes"].append(kind)

        join(machine.before(race["opened"], row))
        runs: dict[str, list[int]] = {}
        for frozen, ranks in race["runs"].items():
            state = machine.thaw(json.loads(frozen))
            machine.step(state, row)
            ended = json.dumps(machine.freeze(state))
            if ended in runs:
                # The longer list takes in the shorter.
                runs[ended], ranks = sorted((runs[ended], ranks), key=len, reverse=True)
                runs[ended].extend(ranks)
            else:
                runs[ended] = ranks
        race["runs"] = runs
        join(machine.after(race["opened"], row))
        return []

    return step


def _race_finish(machine: Mapped) -> Callable:
    def finish(race: dict) -> list[dict]:
        ends = sorted((rank, frozen) for frozen, ranks in race["runs"].items() for rank in ranks)
        out = []
        for rank, frozen in ends:
            kind = race["classes"][rank]
            # A class within the next one that ends alike is not needed.
            while out and out[-1]["_exit"] == frozen and _within(json.loads(out[-1]["_class"]), kind):
                out.pop()
            out.append({"_class": json.dumps(kind), "_exit": frozen, "_rank": rank})
        return out

    return finish


def _within(kind: dict, wider: dict) -> bool:
    return set(kind) == set(wider) == {"upto"} and kind["upto"] <= wider["upto"]


def _walk(machine: Mapped) -> Callable:
    return lambda: {"now": machine.freeze(machine.begin()), "next": None, "part": None}


def _walk_step(machine: Mapped) -> Callable:
    """Chain the maps of a key's blocks: the entry state of each."""

    def step(walk: dict, row: dict) -> list[dict]:
        out = []
        if row["_part"] != walk["part"]:
            if walk["next"] is not None:
                walk["now"] = json.loads(walk["next"])
            walk.update(part=row["_part"], next=None)
            out = [{"_part": row["_part"], "_entry": json.dumps(walk["now"])}]
        if walk["next"] is None:
            kind = json.loads(row["_class"])
            if kind["is"] == walk["now"] if "is" in kind else machine.matches(kind, walk["now"]):
                walk["next"] = row["_exit"]
        return out

    return step


def coupled(df: DataFrame, keys, order, machine: Machine, schema: str, along=None) -> DataFrame:
    """Fold ``df`` by ``machine``, blocks of a key in parallel from the exits of the blocks before.

    ``along`` are rows that cost less to read than ``df``, and columns of both that order them as
    keys and order do: the splitters are taken from these.
    """
    keys, order = list(keys), list(order)
    small, large = _split(df, keys, order, along)
    block = [*keys, "_part"]
    begun = large.withColumn("_entry", F.lit(None).cast("string"))
    first = _replayed(begun, keys, order, machine, schema).where("_exit IS NOT NULL").select(*block, "_exit")
    before = Window.partitionBy(*keys).orderBy("_part")
    guesses = _named(
        first, keys, F.col("_part").alias("_at"), F.col("_exit").alias("_guess"),
        F.lag("_exit").over(before).alias("_entry"),
    )
    entered = large.join(guesses, _block(keys)).drop(*[f"_s{i}" for i in range(len(keys))], "_at")
    # Dealt once more, so that both readers share one run.
    second = _replayed(entered, keys, order, machine, schema).repartition(*block)
    # Of each shared key the first block whose two runs end differently: no more rows than parts.
    wrong = second.where(_above(F.col("_wrong"))).groupBy(*keys).agg(
        F.min_by(F.struct(*second.columns), "_part").alias("_row")
    )
    wrong = _named(wrong, keys, F.col("_row._part").alias("_bad"), F.col("_row._exit").alias("_entry"))
    right = second.where(_above(F.col("_exit").isNull() & F.col("_wrong").isNull())).join(
        F.broadcast(wrong.drop("_entry")), _same(keys), "left"
    ).where("_bad IS NULL OR _part <= _bad")
    rest = large.join(wrong, _same(keys)).where(
        F.coalesce(F.col("_part") > F.col("_bad"), F.lit(False))
    ).drop(*[f"_s{i}" for i in range(len(keys))], "_bad")
    rest = _replayed(rest, keys, order, machine, schema, last=True).where("_exit IS NULL")
    names = _names(schema)
    return (
        _small(small, keys, order, machine, schema)
        .unionByName(right.select(*names)).unionByName(rest.select(*names))
    )
