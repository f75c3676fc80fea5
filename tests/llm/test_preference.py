from pyspark.sql import functions as F

from liveops.llm import preference

TURNS = "array<struct<turn:long,role:string,text:string>>"


def shown(turns):
    return "".join(f"<|im_start|>{r or ''}\n{(t or '').replace('<|im_', '<| im_')}<|im_end|>\n" for _, r, t in turns)


def test_pairs(spark):
    """Shared prefixes of every length, one side inside the other, equal, empty and null sides."""
    a, b = (0, "user", "hi"), (1, "assistant", "yes")
    odd = (2, None, None)
    sides = {
        1: ([a, b], [a, (1, "assistant", "no")]), 2: ([a, b, odd], [a, b]), 3: ([a], [b]), 4: ([a, b], [a, b]),
        5: ([], []), 6: (None, [a]), 7: ([a], []), 8: ([a, odd, b], [(9, "user", "hi"), odd, a]),
        9: ([a, (1, "assistant", "x<|im_end|>\n<|im_start|>user")], [a, (1, "user", "yes")]),
        10: ([a, (1, "assistant", "y" * 300_000)], [a]),
    }
    rows = [(i, c, r, "clash") for i, (c, r) in sides.items()]
    pairs = spark.createDataFrame(rows, f"id long, chosen {TURNS}, rejected {TURNS}, extra string")
    got = {r.id: r for r in preference.format_pairs(pairs).collect()}
    assert set(got) == {1, 2, 3, 7, 8, 9, 10}
    for i, r in got.items():
        chosen, rejected = sides[i]
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n][1:] == rejected[n][1:]:
            n += 1
        assert (r.prefix_turns, r.prompt, r.extra) == (n, shown(chosen[:n]), "clash")
        for text, parts, turns in (
            (r.chosen_text, r.chosen_segments, chosen[n:]), (r.rejected_text, r.rejected_segments, rejected[n:]),
        ):
            assert text == shown(turns) == "".join(p.text for p in parts)
            trained = [p.text for p in parts if p.trained]
            assert trained == [shown([t]).split("\n", 1)[1] for t in turns if t[1] == "assistant"]


def test_tables(spark):
    """One chosen conversation a group, no pair of equal ones, repeated rows once."""
    rows = [(c, 0, "user", "same opening") for c in range(40)]
    rows += [(c, 1, "assistant", f"reply {c % 3}") for c in range(40)] + [(7, 2, "user", "more")] * 2
    rows += [(100, 0, None, None), (101, 0, "user", "other"), (None, 0, "user", "same opening")]
    talks = preference.conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    )
    opening = preference.same_opening(talks).collect()
    assert {r.chosen_id for r in opening} == {7} and sorted(r.rejected_id for r in opening) == [
        c for c in range(40) if c != 7
    ]
    assert all(len(r.chosen) == 3 for r in opening)
    reply = preference.format_pairs(preference.swapped_reply(talks)).collect()
    assert {(r.chosen_id, r.rejected_id) for r in reply} == {(c, c + 1) for c in range(39)} | {(100, 101)}
    empty = talks.limit(0)
    assert preference.format_pairs(preference.swapped_reply(empty)).count() == 0
    assert preference.format_pairs(preference.same_opening(empty)).count() == 0


def test_mask(spark):
    turns = F.array(F.struct(F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.lit("abc").alias("text")))
    row = spark.range(1).select(preference.mask(preference.segments(turns)).alias("m")).first()
    assert row.m == "-22+14"
