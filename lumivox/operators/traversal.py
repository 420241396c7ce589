"""Voxel traversal from plane to plane: the voxels that lines pass, and the length in each.

Every line is a small state machine: the cell it is in, and for each axis the length at
which it meets the next plane. A step passes to the cell behind the nearest plane.
Arrow batches of lines take their steps together in numpy; nothing is shuffled, and a
task holds the segments of one part of a batch. Cells are [i, i + 1) on each axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDS = ("x1", "y1", "z1", "x2", "y2", "z2")
#: Segments that a task holds at a time, about, and the least length of a segment.
SEGMENTS, LEAST = 1 << 20, 1e-9


def trace(start: np.ndarray, delta: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line, cell, w) of all lines' first segments, then of their second ones, and so on.

    ``start`` and ``delta`` have a row of x, y, z per line, ``length`` is what the whole of
    delta counts for. Planes are met at exact multiples, so errors don't add up; the last
    segment ends where the line does. A line along a plane lies in the cell above it.
    """
    cell = np.floor(start).astype(np.int64)
    step = np.sign(delta).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        per_unit = length[:, None] / delta

    def met(line: np.ndarray, axis: np.ndarray | slice) -> np.ndarray:
        """Length at which the plane ahead is met: above the cell, or below it."""
        plane = cell[line, axis] + (step[line, axis] > 0)
        return np.where(step[line, axis] == 0, np.inf, (plane - start[line, axis]) * per_unit[line, axis])

    line = np.flatnonzero((length > 0) & step.any(axis=1))
    ahead, reached = np.full(start.shape, np.inf), np.zeros(len(start))
    ahead[line] = met(line[:, None], np.arange(3)[None, :])
    while len(line):
        axis = ahead[line].argmin(axis=1)
        upto = np.minimum(ahead[line, axis], length[line])
        w = upto - reached[line]
        kept = w > LEAST
        yield line[kept], cell[line[kept]], w[kept]
        reached[line[kept]] = upto[kept]
        more = ahead[line, axis] < length[line]
        line, axis = line[more], axis[more]
        cell[line, axis] += step[line, axis]
        ahead[line, axis] = met(line, axis)


def in_parts(start: np.ndarray, delta: np.ndarray) -> Iterator[slice]:
    """Consecutive lines of about SEGMENTS segments."""
    upto = np.cumsum(np.ceil(np.abs(delta)).sum(axis=1) + 3)
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SEGMENTS, side="right")))
        yield slice(at, end)
        at = end


def voxels_of(cell: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the cells inside a grid of nx, ny, nz, and the voxels of these."""
    inside = ((cell >= 0) & (cell < np.array(shape))).all(axis=1)
    x, y, z = cell[inside].T
    return inside, (z * shape[1] + y) * shape[0] + x


def segments_of(start: np.ndarray, delta: np.ndarray, length: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, vox, w) of all segments inside the grid, by line and along it."""
    lines, voxels, weights = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for line, cell, w in trace(start, delta, length):
        inside, vox = voxels_of(cell, shape)
        lines.append(line[inside])
        voxels.append(vox)
        weights.append(w[inside])
    line = np.concatenate(lines)
    order = np.argsort(line, kind="stable")
    return line[order], np.concatenate(voxels)[order], np.concatenate(weights)[order]


def path_segments(lines: DataFrame, shape: tuple[int, int, int], key: str = "lor_id") -> DataFrame:
    """(key, vox, w) of lines with real ends x1..z2 in a grid of nx, ny, nz voxels: w is the length in the voxel.

    What lies outside the grid is left out; lines without a length give nothing, and
    so do those of which an end is missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ENDS], axis=1)
            start, delta = ends[:, :3], ends[:, 3:] - ends[:, :3]
            for part in in_parts(start, delta):
                line, vox, w = segments_of(start[part], delta[part], np.sqrt((delta[part] ** 2).sum(axis=1)), shape)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(part.start).take(pa.array(line)), pa.array(vox), pa.array(w)], [key, "vox", "w"])

    there = lines.select(F.col(key), *(F.col(c).cast("double").alias(c) for c in ENDS)).dropna(subset=list(ENDS))
    kind = there.schema[key].dataType.simpleString()
    return there.mapInArrow(run, f"{key} {kind}, vox long, w double")


def ray_ends(distance: Column, *, point: str = "x1 y1 z1", direction: str = "dx dy dz") -> list[Column]:
    """Ends x1..z2 of rays given by point, direction and distance; the distance counts in lengths of the direction."""
    points, directions = point.split(), direction.split()
    first = [F.col(c).alias(n) for c, n in zip(points, ENDS)]
    return first + [(F.col(p) + F.col(d) * distance).alias(n) for p, d, n in zip(points, directions, ENDS[3:])]


def ray_segments(rays: DataFrame, shape: tuple[int, int, int], distance: str = "d", key: str = "lor_id") -> DataFrame:
    """(key, vox, w) of rays (x1, y1, z1, dx, dy, dz, distance): lengths count in lengths of the direction, so they add up to the distance."""
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    ends = rays.where(F.col(distance) > 0).select(key, norm.alias("norm"), *ray_ends(F.col(distance)))
    found = path_segments(ends.withColumn("own", F.struct(key, "norm")), shape, "own")
    return found.select(F.col(f"own.{key}").alias(key), "vox", (F.col("w") / F.col("own.norm")).alias("w"))
