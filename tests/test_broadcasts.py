"""Exploded samples look as small as their lines to Spark; no join may broadcast them."""

import re

import pytest
from pyspark.sql import functions as F

from lumivox.jobs import reconstruction as r
from lumivox.queries import QUERIES


def broadcast(df):
    """The nodes below each broadcast of a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+-]*", x)[0]) for x in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            yield "\n".join(lines[k:end])


@pytest.mark.parametrize("name", ["em_distinct_2d", "em_list_dense", "lmem_attenuated_inclusive", "lmem_joined_attenuated"])
def test_samples_are_not_broadcast(spark, data, name):
    plans = list(broadcast(QUERIES[name](spark, data)))
    assert not [x for x in plans if re.search("Generate|MapInArrow", x)]


def test_back_projection_leaves_out_voxels_without_a_line(spark):
    rays = spark.createDataFrame([(1, 5, 1.0), (1, 6, 2.0), (2, 6, 1.0), (3, 7, 1.0)], "lor_id long, vox int, w double")
    lines = spark.createDataFrame([(1, 4.0), (2, 2.0), (4, 1.0)], "lor_id long, q double")
    assert sorted(map(tuple, r.back(rays, lines, 1 / F.col("q")).collect())) == [(5, 0.25), (6, 1.0)]


def test_forward_projection_takes_samples_that_image_and_map_have(spark):
    rays = spark.createDataFrame([(1, 5, 1.0), (1, 6, 2.0), (1, 7, 1.0), (2, 7, 1.0), (3, 9, 1.0), (4, 8, 1.0)], "lor_id long, vox int, w double")
    image = spark.createDataFrame([(5, 3.0), (6, 1.0), (7, 2.0), (8, 0.0)], "vox int, v double")
    mu = spark.createDataFrame([(5, 0.0), (6, 0.0), (8, 0.0), (9, 1.0)], "vox int, mu double")
    assert sorted(map(tuple, r.forward(rays, image).collect())) == [(1, 7.0), (2, 2.0)]
    assert sorted(map(tuple, r.forward(rays, image, mu).collect())) == [(1, 5.0)]
