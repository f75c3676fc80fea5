"""Blocks of one key in parallel: maps of entry states, runs that meet, and runs that never do."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_folds import made, plain, same

from liveops.operators import membership, packets, queues, replay


@pytest.fixture(params=[4, 40])
def parts(request, monkeypatch):
    monkeypatch.setattr(replay, "part_count", lambda df: request.param)
    return request.param


def mapped(machine, rows, entries):
    """Exit states by the map of a block, and by running it from each entry state."""
    race, step = replay._race(machine), replay._race_step(machine)
    for row in rows:
        step(race, row)
    classes = replay._race_finish(machine)(race)
    by_map, by_run = [], []
    for entry in entries:
        walk = replay._walk(machine)()
        walk["now"] = entry
        chain = replay._walk_step(machine)
        for kind in classes:
            chain(walk, kind | {"_part": 0})
        by_map.append(chain(walk, {"_part": 1, "_class": '{"is": 0}', "_exit": "0"})[0]["_entry"])
        state = machine.thaw(entry)
        for row in rows:
            machine.step(state, row)
        by_run.append(replay.json.dumps(machine.freeze(state)))
    return by_map, by_run


@pytest.mark.parametrize("seed", range(30))
def test_maps_of_connections(seed):
    rng = random.Random(seed)
    kinds = ["SYN", "DATA", "DATA", "ACK", "ACK", *(["FIN", "CONNECT", "CLOSE"] if seed % 3 else [])]
    rows = [
        {"us": i, "event_id": i, "kind": rng.choice(kinds), "seq": rng.randrange(8)}
        for i in range(rng.randrange(1, 25))
    ]
    machine = packets.Connection()
    entries = [["LISTEN", 0], ["CLOSED", 0]] + [[s, x] for s in machine.counting for x in range(-5, 15)]
    by_map, by_run = mapped(machine, rows, entries)
    assert by_map == by_run


@pytest.mark.parametrize("seed", range(30))
def test_maps_of_members(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(rng.randrange(1, 25)):
        alive = rng.random() < 0.8
        rows.append({
            "us": i // 2 * 10, "event_id": i, "channel": rng.randrange(3), "alive": alive,
            "action": rng.choice(["JOIN", "JOIN", "LEAVE"]),
            "alive_until": rng.choice([None, i * 5 + rng.randrange(90)]) if alive else None,
        })
    entries = [None] + [[c, u, -7, -1] for c in range(4) for u in (None, *range(-10, 140, 7))]
    by_map, by_run = mapped(membership.Member(), rows, entries)
    assert by_map == by_run


def test_one_key_of_all_rows(spark, parts):
    """A stream after its CLOSE, which no cut reaches, runs in several blocks."""
    rows = made(
        600, 1, stream=lambda r: 0, seq=lambda r: r.randrange(4),
        kind=lambda r: r.choice(["SYN", "DATA", "DATA", "ACK", "FIN", "CONNECT"]),
    )
    rows[2]["kind"] = "CLOSE"
    df = spark.createDataFrame(rows, "stream bigint, us bigint, event_id bigint, kind string, seq int")
    expected = plain(rows, "stream", packets.connection_begin, packets.connection_step)
    same(packets.connections(df), expected, ["stream", "event_id", "state", "delivered"])
    small, large = replay._split(df, ["stream"], ["us", "event_id"])
    assert small.count() == 0
    sizes = [r["count"] for r in large.groupBy("_part").count().collect()]
    assert len(sizes) > parts / 2 and max(sizes) < 4 * 600 / parts


def test_a_queue_that_never_empties(spark, parts):
    """More frames than are served: full all the time, cut nowhere."""
    rows = made(
        900, 2, viewer=lambda r: 7, is_key=lambda r: r.random() < 0.3,
        served=lambda r: r.choice([None, None, 1, 1]),
    )
    for row in rows[:20]:
        row["served"] = None
    df = spark.createDataFrame(rows, "viewer bigint, us bigint, event_id bigint, is_key boolean, served int")
    expected = plain([r | {"capacity": 6} for r in rows], "viewer", queues.queue_begin, queues.queue_step)
    same(queues.backlog(df, 6), expected, ["viewer", "event_id", "dropped_by"])


def counter():
    """A machine that never forgets: runs from different entries never meet."""

    def step(state, row):
        state["n"] += row["v"]
        return [{"id": row["id"], "n": state["n"]}]

    return replay.Steps(
        lambda: {"n": 0}, step, lambda s: s["n"], lambda n: {"n": n}, lambda s: [{"id": -1, "n": s["n"]}]
    )


@pytest.mark.parametrize("always", [True, False])
def test_runs_that_never_meet(spark, parts, always):
    """What comes after them is replayed in order; small and null keys are as ever."""
    rows = spark.range(300).select(
        F.when(F.col("id") < 250, F.lit(None)).otherwise(F.col("id") % 9).alias("k"), "id",
        (F.col("id") % 2 if always else (F.col("id") == 100).cast("long")).alias("v"),
    )
    machine = counter()
    got = replay.coupled(rows, ["k"], ["id"], machine, "k bigint, id bigint, n bigint").collect()
    expected = plain([r.asDict() for r in rows.collect()], "k", machine.begin, machine.step, ("id",), machine.finish)
    assert sorted(((r.k, r.id, r.n) for r in got), key=str) == sorted(
        ((r["k"], r["id"], r["n"]) for r in expected), key=str
    )


def test_no_rows(spark, parts):
    rows = spark.createDataFrame([], "k bigint, id bigint, v bigint")
    assert replay.coupled(rows, ["k"], ["id"], counter(), "k bigint, id bigint, n bigint").collect() == []


def test_each_block_runs_twice(spark, parts, tmp_path):
    """Once from the beginning state and once from its entry, however often the plan names its rows."""
    seen = str(tmp_path / "steps")

    def step(state, row):
        with open(seen, "ab", buffering=0) as file:
            file.write(b".")
        before, state["v"] = state["v"], row["id"]
        return [{"id": row["id"], "before": before}]

    machine = replay.Steps(lambda: {"v": None}, step, lambda s: s["v"], lambda v: {"v": v})
    rows = spark.range(300).select(F.lit(1).cast("bigint").alias("k"), "id")
    got = replay.coupled(rows, ["k"], ["id"], machine, "k bigint, id bigint, before bigint").collect()
    assert sorted((r.id, r.before) for r in got[:]) == sorted((i, i - 1 if i else None) for i in range(300))
    assert os.path.getsize(seen) == 2 * 300
