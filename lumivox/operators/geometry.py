"""Projective maps between planes: estimated from pairs of points, and applied to images."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a map, row by row.
ENTRIES = tuple(f"h{r}{c}" for r in "123" for c in "123")
SIDES = ("1", "2")
#: Second smallest eigenvalue, as a share of the largest, below which pairs don't fix a map.
DEGENERATE = 1e-11


def equations() -> tuple[list[Column], list[Column]]:
    """The two linear equations that a pair (u1, v1) to (u2, v2) sets for the nine entries."""
    u1, v1, u2, v2 = (F.col(c) for c in ("u1", "v1", "u2", "v2"))
    one, zero = F.lit(1.0), F.lit(0.0)
    return [zero, zero, zero, -u1, -v1, -one, v2 * u1, v2 * v1, v2], [u1, v1, one, zero, zero, zero, -u2 * u1, -u2 * v1, -u2]


def homographies(pairs: DataFrame, key: str) -> DataFrame:
    """(key, h11 .. h33, n): the map of each group's pairs (x1, y1) to (x2, y2), h33 being 1.

    Points are moved to their centre and scaled to a mean distance of the square root of
    two. Outer products of the equations are summed by group, so a group may have any
    number of pairs; the eigenvector of the least eigenvalue of these 9 x 9 sums is the
    map. Fewer than four pairs, or pairs that leave the map open (all in a line), give
    nulls; pairs with a missing number don't count. No pairs give no rows.
    """
    points = pairs.select(key, *(F.col(f"{a}{i}").cast("double").alias(f"{a}{i}") for i in SIDES for a in "xy")).dropna(subset=[f"{a}{i}" for i in SIDES for a in "xy"])
    same = lambda df, other: df.join(other.withColumnRenamed(key, "own"), F.col(key).eqNullSafe(F.col("own"))).drop("own")
    centres = points.groupBy(key).agg(*(F.avg(f"{a}{i}").alias(f"c{a}{i}") for i in SIDES for a in "xy"))
    moved = same(points, centres).select(key, *(c for i in SIDES for c in (f"cx{i}", f"cy{i}")), *((F.col(f"{a}{i}") - F.col(f"c{a}{i}")).alias(f"d{a}{i}") for i in SIDES for a in "xy"))
    scales = moved.groupBy(key).agg(*(F.try_divide(F.sqrt(F.lit(2.0)), F.avg(F.hypot(f"dx{i}", f"dy{i}"))).alias(f"s{i}") for i in SIDES))
    scaled = same(moved, scales).select("*", *((F.col(f"d{a}{i}") * F.col(f"s{i}")).alias(f"{n}{i}") for i in SIDES for a, n in zip("xy", "uv")))
    first, second = equations()
    cells = list(combinations_with_replacement(range(9), 2))
    sums = [F.sum(first[r] * first[c] + second[r] * second[c]).alias(f"n{r}{c}") for r, c in cells]
    frame = [f"{n}{i}" for i in SIDES for n in ("cx", "cy", "s")]
    normal = scaled.groupBy(key).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in frame), *sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)  # noqa: E731, B023
            matrix = np.zeros((batch.num_rows, 9, 9))
            for r, c in cells:
                matrix[:, r, c] = matrix[:, c, r] = of(f"n{r}{c}")
            whole = np.isfinite(matrix).all(axis=(1, 2))
            values, vectors = np.linalg.eigh(np.where(whole[:, None, None], matrix, np.eye(9)))
            there = whole & (of("n") >= 4) & (values[:, 1] > DEGENERATE * values[:, -1])
            into, out = np.zeros((batch.num_rows, 3, 3)), np.zeros((batch.num_rows, 3, 3))
            into[:, 0, 0] = into[:, 1, 1] = of("s1")
            into[:, 0, 2], into[:, 1, 2], into[:, 2, 2] = -of("s1") * of("cx1"), -of("s1") * of("cy1"), 1
            out[:, 0, 0] = out[:, 1, 1] = 1 / of("s2")
            out[:, 0, 2], out[:, 1, 2], out[:, 2, 2] = of("cx2"), of("cy2"), 1
            with np.errstate(divide="ignore", invalid="ignore"):
                maps = out @ vectors[:, :, 0].reshape(-1, 3, 3) @ into
                maps = (maps / maps[:, 2:, 2:]).reshape(-1, 9)
            there &= np.isfinite(maps).all(axis=1)
            columns = [pa.array(maps[:, k], mask=~there) for k in range(9)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns, batch.column("n")], [key, *ENTRIES, "n"])

    kind = normal.schema[key].dataType.simpleString()
    return normal.mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{e} double" for e in ENTRIES) + ", n long")


def mapped(x: str, y: str, h: dict[str, str]) -> tuple[str, str, str]:
    """SQL of a point's image before division, and of what divides it."""
    return tuple(f"({h[f'h{r}1']} * ({x}) + {h[f'h{r}2']} * ({y}) + {h[f'h{r}3']})" for r in "123")


def adjugate(h: dict[str, str]) -> dict[str, str]:
    """SQL of the entries of the inverse map, but for a common factor."""
    out = {}
    for r in range(3):
        for c in range(3):
            (a, b), (d, e) = ((c + 1) % 3 + 1, (c + 2) % 3 + 1), ((r + 1) % 3 + 1, (r + 2) % 3 + 1)
            out[f"h{r + 1}{c + 1}"] = f"({h[f'h{a}{d}']} * {h[f'h{b}{e}']} - {h[f'h{a}{e}']} * {h[f'h{b}{d}']})"
    return out


def box(width: int, height: int, h: dict[str, str]) -> dict[str, str]:
    """SQL of the least and most x and y that a map of the image's corners back reaches, without fractions; ``whole`` tells if it is finite."""
    corners = [mapped(str(x), str(y), adjugate(h)) for x, y in ((0, 0), (width, 0), (width, height), (0, height))]
    low, high = (lambda k, f: f"{f}(" + ", ".join(f"{p[k]} / nullif({p[2]}, 0)" for p in corners) + ")"), {}
    for k, a in enumerate("xy"):
        high[f"{a}_least"], high[f"{a}_most"] = low(k, "least"), low(k, "greatest")
    signs = " + ".join(f"sign({p[2]})" for p in corners)
    return high | {"whole": f"abs({signs}) = 4"}


def warp(pixels: DataFrame, maps: DataFrame, width: int, height: int, bilinear: bool = False, key: str = "image_id") -> DataFrame:
    """(key, y, x, v): images seen through maps (key, h11 .. h33) from new places to old ones.

    New images cover the box of the old corners' images. Each place takes the sample
    that it maps to, its fractions left out, or with ``bilinear`` the four around
    it by nearness; places that map outside the samples have no row. A map that sends a
    part of the image to infinity gives nothing. Several maps of one image are told
    apart by nothing but their places, so give one each. One shuffle joins places and samples.
    """
    h = {e: e for e in ENTRIES}
    edges = maps.where(" AND ".join(f"{e} IS NOT NULL" for e in ENTRIES))
    for name, text in box(width, height, h).items():
        edges = edges.withColumn(name, F.expr(text))
    places = edges.where("whole").withColumn("y", F.explode(F.sequence(F.col("y_least").cast("int"), F.col("y_most").cast("int")))).withColumn("x", F.explode(F.sequence(F.col("x_least").cast("int"), F.col("x_most").cast("int"))))
    across, down, part = (F.expr(t) for t in mapped("x", "y", h))
    places = places.where(part != 0).select(key, "y", "x", (across / part).alias("u"), (down / part).alias("w"))
    samples = pixels.select(key, F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    if not bilinear:
        at = places.select(key, "y", "x", F.col("w").cast("int").alias("sy"), F.col("u").cast("int").alias("sx"))
        return at.join(samples, [key, "sy", "sx"]).select(key, "y", "x", "v")
    at = places.where((F.col("u") >= 0) & (F.col("u") <= width - 1) & (F.col("w") >= 0) & (F.col("w") <= height - 1))
    at = at.withColumn("fu", F.col("u") - F.floor("u")).withColumn("fw", F.col("w") - F.floor("w"))
    taps = [
        F.struct((F.floor("w") + j).cast("int").alias("sy"), (F.floor("u") + i).cast("int").alias("sx"), ((F.col("fw") if j else 1 - F.col("fw")) * (F.col("fu") if i else 1 - F.col("fu"))).alias("part"))
        for j in (0, 1) for i in (0, 1)
    ]
    spread = at.select(key, "y", "x", F.explode(F.array(*taps)).alias("t")).where("t.part > 0").select(key, "y", "x", "t.*")
    return spread.join(samples, [key, "sy", "sx"]).groupBy(key, "y", "x").agg(F.sum(F.col("part") * F.col("v")).alias("v"))
