"""The greedy cooldown by composed tables, at any width and fanout, against a plain walk."""

import random

import pytest

from opsloom.operators.rules import _after, _composed, _slice_exits, cooldown_sent

SECOND = 1_000_000


def walk(times, cooldown, sent=None):
    out = []
    for t in sorted(set(times)):
        if sent is None or t - sent > cooldown:
            out.append(t)
            sent = t
    return out


@pytest.mark.parametrize(("slice_s", "fanout"), [(3, 2), (25, 3), (160, 2), (10**6, 8)])
def test_several_series(spark, slice_s, fanout):
    draw = random.Random(slice_s)
    series = {"dense": [draw.randrange(-2000, 2000) for _ in range(1500)],
              "even": list(range(-500, 3000, 5)), "sparse": [-1999, 0, 1, 2900], None: [7, 8, 30]}
    rows = [(k, t * SECOND) for k, ts in series.items() for t in ts] + [("none", None)]
    df = spark.createDataFrame(rows, "rule string, us long").repartition(3)
    got = {}
    for r in cooldown_sent(df, ["rule"], 10, slice_s, fanout).collect():
        got.setdefault(r.rule, []).append(r.us // SECOND)
    assert {k: sorted(v) for k, v in got.items()} == {k: walk(ts, 10) for k, ts in series.items()}


def test_nothing(spark):
    assert cooldown_sent(spark.createDataFrame([], "rule string, us long"), ["rule"], 10).collect() == []


def test_composed_tables_say_what_a_walk_says_and_stay_small():
    draw = random.Random(1)
    for _ in range(300):
        width, cooldown = draw.choice([5, 20, 50]), draw.choice([3, 10, 40])
        slices = [sorted({draw.randrange(i * width, (i + 1) * width) for _ in range(draw.randrange(1, 9))}) for i in range(6)]
        table = _slice_exits(slices[0], cooldown, 0)
        table = ([u for u, _ in table], [x for _, x in table])
        for i, own in enumerate(slices[1:], 1):
            more = _slice_exits(own, cooldown, i * width)
            table = _composed(table, 0, ([u for u, _ in more], [x for _, x in more]), cooldown)
        every = [t for s in slices for t in s]
        assert len(table[0]) <= sum(t <= cooldown for t in every) + 1
        for sent in [None, *range(-cooldown - 2, 0)]:
            assert _after(table, sent, cooldown) == (walk(every, cooldown, sent) or [sent])[-1]
