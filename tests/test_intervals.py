"""Overlap joins: what moves for an interval, in groups that meet whole and in crowded ones that meet by bins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("whole", [0, 35, 2048])
@pytest.mark.parametrize("width", [1, 10, 1000])
def test_overlaps_of_crowded_and_other_groups(spark, monkeypatch, whole, width):
    """All groups by bins, one of them, none: the same pairs, each once; a null group meets nothing."""
    from seqloom.operators import intervals

    monkeypatch.setattr(intervals, "WHOLE", whole)
    r = random.Random(width)
    one = lambda k: (k, (None, "f", "g", "h")[k % 4], a := r.choice((-7, 0, r.randrange(-3000, 3000))), a + r.choice((0, -5, 1, 2, 30, 400, 5000, 1_000_000)))
    a, b = [one(k if k % 4 < 3 else k - 2) for k in range(80)], [one(k) for k in range(80)]
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[1] and x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    sizes = {g: sum(x[1] == g and x[2] < x[3] for x in a + b) for g in "fgh"}
    assert {g for g, n in sizes.items() if n > whole} == {0: {"f", "g", "h"}, 35: {"f"}, 2048: set()}[whole]
    left, right = spark.createDataFrame(a, "i long, g string, start long, end long"), spark.createDataFrame(b, "j long, g string, r_start long, r_end long")
    got = intervals.overlaps(left, right, ["g"], width)
    assert ("Generate" in plan_of(got)) == (whole < 2048)
    assert sorted((x["i"], x["j"], x["overlap"]) for x in got.collect()) == want and len(want) > 100
    for x, y in ((left.limit(0), right), (left, right.limit(0))) if width == 10 else ():
        assert intervals.overlaps(x, y, ["g"], width).collect() == []


def test_an_interval_has_few_bins_however_long(spark):
    """One level's bins, not some of every level's; starts go to no level that the other side has nothing in."""
    from seqloom.operators.intervals import _chain, _cover

    ends = [(-12345, 10_000_000), (0, 0), (0, 7), (1, 8), (-1, 6), (1, 63), (5, 2**40), (-(2**59), 2**59)]
    df = spark.createDataFrame(ends, "a long, b long")
    for x in df.select("a", "b", _cover(F.col("a"), F.col("b"), 20).alias("c")).collect():
        assert 1 <= len(x.c) <= 9 and len({c.level for c in x.c}) == 1
        k = 3 * x.c[0].level
        assert [c.bin for c in x.c] == list(range(x.a >> k, (x.b >> k) + 1)) and (k == 0 or 1 << k <= x.b - x.a + 1)
    assert [tuple(c) for c in spark.range(1).select(_chain(F.lit(-1000).cast("long"), [0, 2]).alias("c")).first().c] == [(0, -1000), (2, -16)]


def test_long_intervals_of_orders_move_once(spark, sf):
    """A customer has few orders, so none is copied to bins."""
    from seqloom.plans import QUERIES

    assert "Generate" not in plan_of(QUERIES["j7c_long_intervals"](spark, sf))
