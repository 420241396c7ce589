"""Draws down the pyramid against a plain search, and against the same draws by intervals."""

import bisect
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lumivox.operators import pyramid
from lumivox.queries import QUERIES


def levels_of(values):
    out = [values]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([sum(below[i : i + 3]) / 3 for i in range(0, len(below) // 3 * 3, 3)] + [below[-1]])
    return out


def searched(levels, u):
    """Entry and steps of a search that starts below the middle of what was found above."""
    j = steps = 0
    for values in levels[-2::-1]:
        j = first = min(3 * j + 1, len(values) - 1)
        if values[j] < u:
            while values[j] < u:
                j, steps = j + 1, steps + 1
        else:
            while j >= 0 and values[j] >= u:
                j, steps = j - 1, steps + 1
            j += 1
        assert first >= 0
    return j, steps


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 27, 100, 365])
def test_draws(spark, n):
    rng = random.Random(n)
    weights = [rng.choice([0, 0, 1, 2, 50]) for _ in range(n - 1)] + [7]
    upto = list(itertools.accumulate(weights))
    built = pyramid.build(spark.createDataFrame(list(enumerate(map(float, upto))), "j long, v double").repartition(3))
    want = levels_of([float(x) for x in upto])
    assert [x.n for x in built] == [len(x) for x in want]
    for x, values in zip(built, want):
        assert [r.v for r in x.rows.orderBy("j").collect()] == pytest.approx(values)
    us = sorted({1, upto[-1], *(rng.randint(1, upto[-1]) for _ in range(60))})
    found = pyramid.descend(spark.createDataFrame([(u,) for u in us], "u long"), built)
    got = {r.u: (r.j, r.steps) for r in found.collect()}
    assert got == {u: searched(want, u) if n > 1 else (0, 0) for u in us}
    assert all(j == bisect.bisect_left(upto, u) for u, (j, _) in got.items())


def test_nothing_to_draw_from(spark):
    empty = spark.createDataFrame([], "j long, v double")
    assert pyramid.descend(spark.range(3).withColumnRenamed("id", "u"), pyramid.build(empty)).count() == 0
    one = pyramid.build(spark.createDataFrame([(0, 5.0)], "j long, v double"))
    assert [r.u for r in pyramid.descend(spark.createDataFrame([(5,), (6,)], "u long"), one).collect()] == [5]
    with pytest.raises(ValueError, match="one entry"):
        pyramid.descend(spark.range(1), pyramid.build(spark.range(9).select(F.col("id").alias("j"), F.col("id").alias("v")), 1))


def test_same_draws_as_by_intervals(spark, data):
    both = QUERIES["msps_gen"](spark, data).select("event_id", "idx").exceptAll(QUERIES["cdf_sample"](spark, data))
    assert both.count() == 0
