"""Projective maps, greedy matching, pairs of crystals, corners and tracks against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumivox.functions import scanner as sc
from lumivox.operators import features, geometry, matching, tracking


def test_known_maps_are_recovered(spark):
    rng = np.random.default_rng(1)
    rows, maps = [], {}
    for k in range(12):
        h = np.eye(3) + rng.uniform(-0.3, 0.3, (3, 3)) * [[1, 1, 50], [1, 1, 50], [0.001, 0.001, 0]]
        maps[k] = h / h[2, 2]
        for x, y in rng.uniform(0, 200, (4 if k == 0 else 30, 2)):
            u, v, w = h @ [x, y, 1]
            rows.append((k, float(x), float(y), float(u / w), float(v / w)))
    rows += [(90, float(i), float(2 * i), float(i), float(i)) for i in range(9)]  # all in a line
    rows += [(91, 0.0, 0.0, 1.0, 1.0), (91, 1.0, 0.0, 2.0, 1.0), (91, 0.0, 1.0, 1.0, 2.0), (91, None, 5.0, 1.0, 1.0)]
    rows += [(92, 3.0, 3.0, 1.0, 1.0)] * 6  # one place
    pairs = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    found = {r.k: r for r in geometry.homographies(pairs, "k").collect()}
    for k, h in maps.items():
        assert np.abs(np.array([found[k][e] for e in geometry.ENTRIES]).reshape(3, 3) - h).max() < 1e-6 * max(1, np.abs(h).max())
    assert all(found[k].h11 is None for k in (90, 91, 92)) and found[91].n == 3
    assert geometry.homographies(pairs.where("false"), "k").count() == 0


def test_noise_leaves_small_residuals(spark):
    rng = np.random.default_rng(2)
    h = np.array([[1.1, 0.1, 5], [-0.2, 0.9, 3], [0.0005, -0.0002, 1]])
    points = rng.uniform(0, 100, (200, 2))
    seen = np.c_[points, np.ones(200)] @ h.T
    seen = seen[:, :2] / seen[:, 2:] + rng.normal(0, 0.01, (200, 2))
    pairs = spark.createDataFrame([(1, *map(float, [*p, *q])) for p, q in zip(points, seen)], "k long, x1 double, y1 double, x2 double, y2 double")
    row = geometry.homographies(pairs, "k").first()
    back = np.c_[points, np.ones(200)] @ np.array([row[e] for e in geometry.ENTRIES]).reshape(3, 3).T
    assert np.abs(back[:, :2] / back[:, 2:] - seen).max() < 0.06


def test_warps_of_awkward_maps(spark):
    pixels = spark.createDataFrame([(k, y, x, float(10 * y + x)) for k in range(4) for y in range(5) for x in range(6)], "image_id long, y int, x int, v double")
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    maps = [(0, *one), (1, 1.0, 0.0, 2.0, 0.0, 1.0, -1.0, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.5, 0.0, 1.0), (3, *[None] * 9)]
    maps = spark.createDataFrame(maps, "image_id long, " + ", ".join(f"{e} double" for e in geometry.ENTRIES))
    for bilinear in (False, True):
        found = {(r.image_id, r.y, r.x): r.v for r in geometry.warp(pixels, maps, 6, 5, bilinear).collect()}
        assert {k[0] for k in found} == {0, 1}  # a corner of 2 goes past infinity
        assert all(v == pytest.approx(10 * y + x) for (k, y, x), v in found.items() if k == 0) and sum(k[0] == 0 for k in found) == 30
        assert all(v == pytest.approx(10 * (y - 1) + x + 2) for (k, y, x), v in found.items() if k == 1) and (1, 1, -2) in found


def greedy(n, m, dist):
    left, out = set(range(m)), {}
    for i in range(n):
        known = [(dist[i, j], j) for j in left if (i, j) in dist]
        if known:
            out[i] = min(known)[1]
            left.discard(out[i])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_matching(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for group in range(6):
        n, m = rng.randrange(1, 12), rng.randrange(1, 12)
        dist = {(i, j): float(rng.randrange(4)) for i in range(n) for j in range(m) if rng.random() < 0.9}
        rows += [(group, i, j, d) for (i, j), d in dist.items()]
        want |= {(group, i): j for i, j in greedy(n, m, dist).items()}
    df = spark.createDataFrame(rows + [(0, 0, 99, None)], "g long, i long, j long, dist double").repartition(3)
    assert {(r.g, r.i): r.j for r in matching.greedy_pairs(df, "g").collect()} == want
    assert matching.greedy_pairs(df.where("false"), "g").count() == 0


def test_a_chain_of_displacements(spark):
    """Everyone wants the same one first, so each round settles one."""
    df = spark.createDataFrame([(1, i, j, float(j)) for i in range(12) for j in range(12)], "g long, i long, j long, dist double")
    assert {r.i: r.j for r in matching.greedy_pairs(df, "g").collect()} == {i: i for i in range(12)}


@pytest.mark.parametrize("members", [0, 1, 2, 3, 17, 40])
def test_all_pairs_and_their_numbers(spark, members):
    found = [(r.n, r.i1, r.i2) for r in sc.all_pairs(spark, members).orderBy("n").collect()]
    assert found == [(n, *p) for n, p in enumerate((i, j) for i in range(members) for j in range(i + 1, members))]
    low, high = sc.pair_of(F.col("n"))
    numbers = spark.range(members * (members - 1) // 2).withColumnRenamed("id", "n").withColumns({"i": low, "j": high})
    assert numbers.where((sc.pair_id(F.col("i"), F.col("j")) != F.col("n")) | (F.col("i") >= F.col("j"))).count() == 0


def test_numbers_of_large_rings(spark):
    """Roots of numbers near squares, up to those of ten million crystals."""
    near = [k * (k - 1) // 2 + d for k in (17864, 94906267, 9_999_999, 3_000_000) for d in (-1, 0, 1)]
    low, high = sc.pair_of(F.col("n"))
    for r in spark.createDataFrame([(n,) for n in near], "n long").select("n", low.alias("i"), high.alias("j")).collect():
        assert 0 <= r.i < r.j and r.i + r.j * (r.j - 1) // 2 == r.n
    assert sc.crystal_pairs(spark, sc.RING_22).count() == 159_552_316


def test_corners_of_a_square(spark):
    image = np.zeros((40, 48))
    image[15:27, 17:33] = 1
    df = spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(image)] + [(2, 0, 0, 1.0), (2, 3, 3, 1.0)], "k long, y int, x int, v double")
    found = features.corners(df, "k")
    best = features.at_most(found, "k", 4).collect()
    assert len(best) == 4 and all(min(abs(r.y - 15), abs(r.y - 26)) <= 2 and min(abs(r.x - 17), abs(r.x - 32)) <= 2 for r in best)
    assert {r.k for r in found.collect()} == {1} and features.above(found, 0).count() == found.count()
    assert features.at_most(found, "k", 0).where("threshold > 0").count() == 0  # even the top leaves more


@pytest.mark.parametrize("block", [2, 3, 50])
def test_tracks(spark, block):
    rng = np.random.default_rng(3)
    size, rows, want = (12, 14), [], []
    for seq, n in ((1, 11), (2, 1), (3, 7)):
        scene, at = rng.uniform(0, 1, (60, 60)), (24, 24)
        for frame in range(n):
            want.append((seq, frame, 6 + 24 - at[0], 7 + 24 - at[1]))
            if not (seq == 3 and frame == 4):  # a gap: nothing is followed across it
                rows += [(seq, frame, y, x, float(scene[at[0] + y, at[1] + x])) for y in range(size[0]) for x in range(size[1])]
            step = rng.integers(-1, 2, 2)
            at = tuple(a + s if abs(a + s - 24) <= 3 else a for a, s in zip(at, step.tolist()))
    frames = spark.createDataFrame(rows, "seq long, frame int, y int, x int, v double").repartition(3)
    found = tracking.tracks(frames, size, (6, 7), 3, (1, 1), block=block)
    assert sorted(tuple(r) for r in found.collect()) == [w for w in want if not (w[0] == 3 and w[1] >= 4)]
    mean = {(r.y, r.x): r.v for r in tracking.registered_mean(frames, found).where("seq = 2").collect()}
    assert mean == {(y, x): v for s, _, y, x, v in rows if s == 2}
