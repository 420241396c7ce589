"""Corners of images: Harris response, suppression, and thresholds for a wanted number.

One image is one group, as in Fourier transforms: it is gathered by one shuffle, and all
windows slide over it in numpy. Images are many and each is small enough for a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side and deviation of the smoothing window, weight of the squared trace, side of the suppression window.
SMOOTH, DEVIATION, TRACE, SUPPRESS = 13, 2.0, 0.04, 7
#: The response is scaled to this most; thresholds are whole numbers up to it.
TOP = 255


def windowed(image: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Weighted sums over full windows, the weights being a column times a row; places without a full window have 0."""
    a, b, out = len(rows) // 2, len(columns) // 2, np.zeros(image.shape)
    if min(image.shape[0] - 2 * a, image.shape[1] - 2 * b) > 0:
        down = np.tensordot(sliding_window_view(image, len(rows), axis=0), rows, axes=([2], [0]))
        out[a : image.shape[0] - a, b : image.shape[1] - b] = np.tensordot(sliding_window_view(down, len(columns), axis=1), columns, axes=([2], [0]))
    return out


def response(image: np.ndarray) -> np.ndarray:
    """Harris response, scaled to 0 .. TOP; a flat response is 0."""
    step, ones = np.array([-1.0, 0.0, 1.0]), np.ones(3)
    gx, gy = windowed(image, ones, step), windowed(image, step, ones)
    bell = np.exp(-(np.arange(-(SMOOTH // 2), SMOOTH // 2 + 1) ** 2) / (2 * DEVIATION**2))
    xx, yy, xy = (windowed(p, bell, bell) for p in (gx * gx, gy * gy, gx * gy))
    found = xx * yy - xy * xy - TRACE * (xx + yy) ** 2
    spread = found.max() - found.min()
    return (found - found.min()) / spread * TOP if spread > 0 else np.zeros(found.shape)


def suppressed(values: np.ndarray, side: int) -> np.ndarray:
    """Values that are the largest of their full window (equal ones all stay), 0 elsewhere."""
    reach, out = side // 2, np.zeros(values.shape)
    if min(values.shape) >= side:
        inner = values[reach:-reach, reach:-reach]
        most = sliding_window_view(values, (side, side)).max(axis=(2, 3))
        out[reach:-reach, reach:-reach] = np.where(inner == most, inner, 0)
    return out


def corners(samples: DataFrame, key: str) -> DataFrame:
    """(key, y, x, v): places with a response above 0 that is the largest around, v from 0 to TOP.

    Images reach from 0 to their largest y and x; absent samples are 0. Images smaller than a window
    have no corners.
    """

    def run(rows: pa.Table) -> pa.Table:
        y, x = (rows.column(c).to_numpy() for c in "yx")
        image = np.zeros((y.max() + 1, x.max() + 1))
        image[y, x] = rows.column("v").to_numpy()
        found = suppressed(response(image), SUPPRESS)
        at = np.nonzero(found > 0)
        ids = np.full(len(at[0]), rows.column(key)[0].as_py(), np.int64)
        return pa.table([pa.array(ids), pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(found[at])], [key, "y", "x", "v"])

    typed = samples.select(F.col(key).cast("long").alias(key), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return typed.where(f"{key} IS NOT NULL AND y >= 0 AND x >= 0 AND v IS NOT NULL").groupBy(key).applyInArrow(run, f"{key} long, y int, x int, v double")


def above(found: DataFrame, threshold: float) -> DataFrame:
    """Corners whose response is at least the threshold."""
    return found.where(F.col("v") >= threshold)


def at_most(found: DataFrame, key: str, wanted: int) -> DataFrame:
    """(key, threshold, y, x, v): for each image the corners above the least whole threshold, from 1, that leaves ``wanted`` at most.

    Counts by whole response are summed from the top, so an image has at most TOP + 1 of them
    however many corners it has. Where even TOP leaves more, all corners stay, with threshold 0.
    """
    levels = found.groupBy(key, F.floor("v").cast("int").alias("level")).agg(F.count("*").alias("n"))
    counts = levels.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("n"))
    # corners at or above a whole threshold are those of its level and the levels above
    steps = F.sequence(F.lit(1), F.lit(TOP))
    left = lambda th: F.aggregate(F.filter(F.map_entries("n"), lambda e: e["key"] >= th), F.lit(0).cast("long"), lambda s, e: s + e["value"])
    least = counts.select(key, F.coalesce(F.array_min(F.filter(steps, lambda th: left(th) <= wanted)), F.lit(0)).alias("threshold"))
    return found.join(least, key).where(F.col("v") >= F.col("threshold")).select(key, "threshold", "y", "x", "v")
