"""Iterative reconstruction, by lines or as joins and grouped sums.

By lines: an image of at most GRID_CELLS voxels goes to every task, which projects its
lines in Arrow batches and adds their ratios to an image of its own; only these partial
images are summed, and no line or ray sample is shuffled. Samples lie a step of the
longest axis apart and count 1, or are exact path lengths.

As joins, for other weights and larger grids: a system matrix is a table (lor_id, vox,
w). Forward projection is a join with the image and a sum by line; back projection is a
join with the lines and a sum by voxel. ``em_step`` takes this way above GRID_CELLS.
Spark takes exploded samples for as small as their lines, so the joins are outer ones from
the samples' side: the other side alone may be broadcast. Sums pass over what is not met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.functions.scanner import samples_of
from lumivox.lineage import cut
from lumivox.operators.traversal import path_segments, segments_of

#: Voxels of an image that goes to every task (8 bytes each), and ray samples that are held at a time.
GRID_CELLS, SAMPLES = 1 << 22, 1 << 20


def gathered(image: DataFrame, cells: int, column: str = "v") -> np.ndarray:
    """An image's values by voxel; its size is that of the grid, not of the data."""
    if cells > GRID_CELLS:
        raise ValueError("images of larger grids are joined, see em_step()")
    rows = image.select("vox", column).toArrow()
    out = np.zeros(cells)
    out[rows.column("vox").to_numpy()] = rows.column(column).to_numpy()
    return out


def pieces(lengths: np.ndarray) -> Iterator[slice]:
    """Consecutive lines of about SAMPLES steps."""
    upto = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SAMPLES, side="right")))
        yield slice(start, end)
        start = end


def stepped(own: dict[str, np.ndarray], grid: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, vox, w) of integer lines: one voxel a step of the longest axis, each counting 1."""
    length = own["len"].astype(np.int64)
    line = np.repeat(np.arange(len(length)), length)
    n = np.arange(len(line)) - (np.cumsum(length) - length)[line]
    z, y, x = (own[f"{a}1"].astype(np.int64)[line] + np.floor(n * (own[f"{a}2"] - own[f"{a}1"])[line] / length[line]).astype(np.int64) for a in "zyx")
    return line, (z * grid[1] + y) * grid[0] + x, np.ones(len(line))


def exact(own: dict[str, np.ndarray], grid: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, vox, w): exact path lengths of lines between the middles of voxels."""
    start, stop = (np.stack([own[f"{a}{i}"] for a in "xyz"], axis=1) + 0.5 for i in "12")
    return segments_of(start, stop - start, np.sqrt(((stop - start) ** 2).sum(axis=1)), grid)


WEIGHTS = {"steps": stepped, "lengths": exact}


def back_by_lines(
    lines: DataFrame, grid: tuple[int, int, int], image: np.ndarray | None = None, mu: np.ndarray | None = None, scale: float = 0.5, count: str | None = None, weights: str = "steps"
) -> DataFrame:
    """(vox, f): each line's count over its projection, or, without an image, its count alone, summed over its voxels.

    Lines (x1..z2, len and ``count``) have the samples that ``weights`` names, in a grid of
    nx, ny, nz; lines without a step or with a projection of zero give nothing.
    """
    cells = grid[0] * grid[1] * grid[2]
    ends = [f"{a}{i}" for a in "xyz" for i in "12"]
    samples = WEIGHTS[weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.zeros(cells)
        for batch in batches:
            every = {c: batch.column(c).to_numpy().astype(np.float64) for c in (*ends, "len")}
            counts = batch.column(count).to_numpy() if count else np.ones(batch.num_rows)
            for rows in pieces(every["len"] if weights == "steps" else 3 * every["len"] + 3):
                own = {c: v[rows] for c, v in every.items()}
                line, vox, w = samples(own, grid)
                weight = counts[rows].astype(np.float64)
                if image is not None:
                    q = np.bincount(line, w * image[vox], len(weight))
                    if mu is not None:
                        q *= np.exp(-scale * np.bincount(line, w * mu[vox], len(weight)))
                    weight = np.divide(weight, q, out=np.zeros(len(q)), where=q != 0)
                f += np.bincount(vox, w * weight[line], cells)
        met = np.flatnonzero(f)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(f[met])], ["vox", "f"])

    columns = [*ends, "len", *([count] if count else [])]
    return lines.where("len > 0").select(*columns).mapInArrow(run, "vox int, f double").groupBy("vox").agg(F.sum("f").alias("f"))


def rays_of(lines: DataFrame, grid: tuple[int, int, int], weights: str) -> DataFrame:
    """(lor_id, vox, w): the same samples as a table."""
    if weights == "steps":
        return samples_of(lines, grid[0], grid[1]).withColumn("w", F.lit(1.0))
    middles = lines.select("lor_id", *((F.col(f"{a}{i}") + 0.5).alias(f"{a}{i}") for i in "12" for a in "xyz"))
    return path_segments(middles, grid).select("lor_id", F.col("vox").cast("int").alias("vox"), "w")


def em_step(
    lines: DataFrame, image: DataFrame, grid: tuple[int, int, int], mu: DataFrame | None = None, scale: float = 0.5, counts: DataFrame | None = None, weights: str = "steps", norm: DataFrame | None = None, most_cells: int = GRID_CELLS
) -> DataFrame:
    """(vox, v) after one step over lines (lor_id, x1..z2, len); ``mu`` has (vox, mu), ``counts`` (lor_id, n).

    Up to ``most_cells`` voxels the image goes to the lines; beyond, lines, image and map
    are joined as tables, so no task and not the driver holds an image. Both give the same.
    """
    cells = grid[0] * grid[1] * grid[2]
    if cells > most_cells:
        f = expectation(rays_of(lines, grid, weights), image, mu, scale, counts)
    else:
        counted = lines if counts is None else lines.join(counts.select("lor_id", "n"), "lor_id")
        f = back_by_lines(counted, grid, gathered(image, cells), None if mu is None else gathered(mu, cells, "mu"), scale, None if counts is None else "n", weights)
    return update(image, f, norm)


def forward(rays: DataFrame, image: DataFrame, mu: DataFrame | None = None, scale: float = 0.5) -> DataFrame:
    """(lor_id, q): what the image projects on each line, attenuated by exp(-scale * sum of mu); zeros are dropped.

    Samples that the image or the map lacks count for neither; rays are never broadcast.
    """
    seen, q = rays.join(image, "vox", "left"), F.col("w") * F.col("v")
    if mu is None:
        sums = seen.groupBy("lor_id").agg(F.sum(q).alias("q"))
    else:
        both = F.col("v").isNotNull() & F.col("mu").isNotNull()
        seen = seen.join(mu, "vox", "left")
        sums = seen.groupBy("lor_id").agg(F.sum(F.when(both, q)).alias("q"), F.sum(F.when(both, F.col("w") * F.col("mu"))).alias("a"))
        sums = sums.select("lor_id", (F.col("q") * F.exp(-scale * F.col("a"))).alias("q"))
    return sums.where("q <> 0")


def back(rays: DataFrame, lines: DataFrame, value: Column) -> DataFrame:
    """(vox, f): sums over the lines through each voxel; rays are never broadcast."""
    return rays.join(lines, "lor_id", "left").groupBy("vox").agg(F.sum(F.col("w") * value).alias("f")).where("f IS NOT NULL")


def expectation(rays: DataFrame, image: DataFrame, mu: DataFrame | None = None, scale: float = 0.5, counts: DataFrame | None = None) -> DataFrame:
    """(vox, f) of one step: each line gives its count over its projection to its voxels."""
    q = forward(rays, image, mu, scale)
    if counts is not None:
        return back(rays, q.join(counts, "lor_id"), F.col("n") / F.col("q"))
    return back(rays, q, 1 / F.col("q"))


def update(image: DataFrame, f: DataFrame, norm: DataFrame | None = None) -> DataFrame:
    """image * f / norm; voxels that no line meets become 0, as do those without a norm."""
    out = image.join(f, "vox", "left")
    factor = F.coalesce("f", F.lit(0.0))
    if norm is not None:
        out = out.join(norm, "vox", "left")
        factor = F.coalesce(F.try_divide(factor, F.col("norm")), F.lit(0.0))
    return out.select("vox", (F.col("v") * factor).alias("v"))


def ordered_subsets(lines: DataFrame, image: DataFrame, subset: Column, subsets: int, grid: tuple[int, int, int], passes: int = 1, **step) -> DataFrame:
    """EM over subsets of lines, the image updated after each; lineage is cut between them.

    ``subset`` numbers each line from 0, ``grid`` is (nx, ny, nz). What ``em_step`` takes
    besides is given by name.
    """
    for n in range(passes * subsets):
        image = em_step(lines.where(subset == n % subsets), image, grid, **step)
        if n + 1 < passes * subsets:
            image = cut(image)
    return image
