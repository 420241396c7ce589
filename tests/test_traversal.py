"""Voxel traversal against planes crossed one by one, and matrices on disk."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumivox import grid
from lumivox.jobs import reconstruction as r
from lumivox.jobs.stored import StoredMatrix
from lumivox.operators import traversal as t
from lumivox.queries.reconstruction import GRID, mumap, start
from lumivox.queries.traversal import real_lines


def crossings(start, stop, shape):
    """{voxel: length} of one line, from all planes in its way."""
    start, delta = np.array(start), np.array(stop) - np.array(start)
    cuts = {0.0, 1.0}
    for a in range(3):
        if delta[a]:
            low, high = sorted((start[a], start[a] + delta[a]))
            cuts |= {(k - start[a]) / delta[a] for k in range(int(np.ceil(low)), int(np.floor(high)) + 1)}
    cuts = sorted(x for x in cuts if 0 <= x <= 1)
    out = {}
    for b, a in zip(cuts, cuts[1:]):
        w = (a - b) * np.linalg.norm(delta)
        cell = np.floor(start + (a + b) / 2 * delta).astype(int)
        if w > 1e-9 and all(0 <= c < n for c, n in zip(cell, shape)):
            vox = int((cell[2] * shape[1] + cell[1]) * shape[0] + cell[0])
            out[vox] = out.get(vox, 0) + w
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(spark, seed):
    rng, shape = np.random.default_rng(seed), (9, 7, 5)
    ends = rng.uniform(-3, 12, (300, 6))
    ends[::7, 3] = ends[::7, 0]  # within a plane
    ends[::11, 3:5] = ends[::11, :2]  # along an axis
    ends[::13] = np.floor(ends[::13])  # on planes, edges and corners
    ends[5, 3:] = ends[5, :3]  # no length
    ends[6, :] = [0, 0, 0, 5, 5, 5]
    ends[8, :] = [5, 5, 5, 0, 0, 0]
    lines = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(ends)], "lor_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    found = {}
    for row in t.path_segments(lines.repartition(3), shape).collect():
        assert row.vox not in found.setdefault(row.lor_id, {})
        found[row.lor_id][row.vox] = row.w
    for i, x in enumerate(ends):
        want = crossings(x[:3], x[3:], shape)
        got = found.get(i, {})
        if not want.keys() == got.keys():  # lines within a plane lie in the cells above it, whichever way they go
            assert any(x[a] == x[a + 3] == np.floor(x[a]) for a in range(3))
        assert abs(sum(want.values()) - sum(got.values())) < 1e-6
        assert all(abs(got[v] - want[v]) < 1e-6 for v in want.keys() & got.keys())


def test_lengths_add_up(spark, data):
    lines = real_lines(spark, data)
    sums = t.path_segments(lines, GRID).groupBy("lor_id").agg(F.sum("w").alias("w")).join(lines, "lor_id")
    off = sums.where("abs(w - sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2) + pow(z2 - z1, 2))) > 1e-6")
    assert off.count() == 0 and sums.count() == lines.count()


def test_missing_ends_and_odd_rays(spark):
    lines = spark.createDataFrame([(1, 0.5, None, 0.5, 3.5, 0.5, 0.5), (2, 0.5, 0.5, 0.5, 2.5, 0.5, 0.5)], "lor_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    assert sorted(tuple(x) for x in t.path_segments(lines, (4, 4, 4)).collect()) == [(2, 0, 0.5), (2, 1, 1.0), (2, 2, 0.5)]
    rays = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 2.0, 0.0, 0.0, 1.0), (2, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 1.0), (3, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0)], "lor_id long, x1 double, y1 double, z1 double, dx double, dy double, dz double, d double")
    assert sorted(tuple(x) for x in t.ray_segments(rays, (4, 4, 4)).collect()) == [(1, 0, 0.25), (1, 1, 0.5), (1, 2, 0.25)]
    assert t.path_segments(lines.where("false"), (4, 4, 4)).count() == 0


def test_no_planes_are_exploded(spark, data):
    plan = t.path_segments(real_lines(spark, data), GRID)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("weights", ["steps", "lengths"])
def test_both_ways_of_a_step_agree(spark, data, weights):
    lines = grid.lors(spark, data)
    counts = lines.select("lor_id", (1 + F.col("lor_id") % 3).alias("n"))
    images = [{x.vox: x.v for x in r.em_step(lines, start(spark), GRID, mumap(spark), 0.5, counts, weights, most_cells=m).collect()} for m in (0, r.GRID_CELLS)]
    assert images[0].keys() == images[1].keys() and all(abs(v - images[1][k]) < 1e-9 for k, v in images[0].items())


def tree_of(df):
    """(depth, node) of the plan that ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [(len(m[1]), m[2]) for m in re.finditer(r"^([\s:+\-*()0-9]*?)(?:\*\(\d+\) )?([A-Z].*)$", text, re.M)]


def between_scan_and_join(nodes, table):
    """Nodes above each scan of a table up to the join."""
    for i, (depth, node) in enumerate(nodes):
        if "Scan parquet" in node and table in node:
            above = []
            for d, n in reversed(nodes[:i]):
                if d < depth:
                    above.append(n)
                    depth = d
                if "Join" in n and d == depth:
                    break
            yield above


def test_stored_matrix_meets_images_and_lines_without_exchange(spark, data):
    matrix = StoredMatrix(r.rays_of(grid.lors(spark, data), GRID, "lengths"), buckets=3)
    q = matrix.forward(start(spark))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with images that no task holds
    try:
        for df, key in ((matrix.forward(start(spark)), "vox"), (matrix.back(q, 1 / F.col("q")), "lor_id")):
            found = list(between_scan_and_join(tree_of(df), f"{matrix.name}_{key}"))
            assert found and all("Join" in x[-1] and not any("Exchange" in n for n in x) for x in found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    matrix.drop()
