"""A feature followed through frames, and the mean of the frames brought into line.

Where a feature goes from one frame to the next depends on where it is, so a pair of
frames gives a map from each place to the next. Maps are composed: within blocks
of frames, then over blocks, so a long sequence is not walked in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.lineage import cut

#: Frames whose maps one task composes.
BLOCK = 64


def next_places(frames: DataFrame, size: tuple[int, int], window: int, reach: tuple[int, int], seq: str = "seq") -> DataFrame:
    """(seq, frame, map): for every place of a frame (row by row) the likest within ``reach`` in the next frame.

    Likest is the least sum of squared differences of windows, of a tie the first in the order
    of rows. Only windows inside the image count; a place whose own window is not stays.
    Frames are numbered from 0; the last of a sequence, and one before a gap, has no map.
    """
    height, width = size
    gathered = frames.groupBy(seq, "frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p")).select(seq, "frame", F.transform("p", lambda p: p["v"]).alias("v"), F.size("p").alias("n")).where(F.col("n") == height * width)
    following = gathered.select(seq, (F.col("frame") - 1).alias("frame"), F.col("v").alias("w"))
    rad = window // 2

    def mapped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.arange(height * width)
        for y in range(rad, height - rad):
            for x in range(rad, width - rad):
                own, best = a[y - rad : y + rad + 1, x - rad : x + rad + 1], None
                for j in range(max(rad, y - reach[0]), min(height - rad, y + reach[0] + 1)):
                    for i in range(max(rad, x - reach[1]), min(width - rad, x + reach[1] + 1)):
                        apart = round(float(((b[j - rad : j + rad + 1, i - rad : i + rad + 1] - own) ** 2).sum()), 9)
                        if best is None or apart < best:
                            best, out[y * width + x] = apart, j * width + i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [mapped(np.array(a).reshape(size), np.array(b).reshape(size)).tolist() for a, b in zip(batch.column("v").to_pylist(), batch.column("w").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(seq), batch.column("frame"), pa.array(rows, pa.list_(pa.int32()))], [seq, "frame", "map"])

    pairs = gathered.drop("n").join(following, [seq, "frame"]).select(F.col(seq).cast("long").alias(seq), F.col("frame").cast("int").alias("frame"), "v", "w")
    return pairs.mapInArrow(run, f"{seq} long, frame int, map array<int>")


def composed(maps: DataFrame, seq: str, block: int) -> DataFrame:
    """(seq, frame, map): from each place of frame 0 to that of ``frame + 1``, for frames without a gap before."""
    if block < 2:
        raise ValueError("a block has two frames at least")

    def within(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame")
        out, now = [], None
        for m in rows.column("map").to_pylist():
            now = np.array(m) if now is None else np.array(m)[now]
            out.append(now.tolist())
        return pa.table({seq: rows.column(seq), "frame": rows.column("frame"), "map": pa.array(out, pa.list_(pa.int32()))})

    schema = f"{seq} long, frame int, map array<int>"
    blocked = maps.withColumn("block", F.floor(F.col("frame") / block).cast("int"))
    inside = cut(blocked.groupBy(seq, "block").applyInArrow(within, schema))
    if inside.where(F.col("frame") >= block).isEmpty():
        return inside
    last = inside.where((F.col("frame") + 1) % block == 0).select(seq, F.floor(F.col("frame") / block).cast("int").alias("frame"), "map")
    before = composed(last, seq, block).select(seq, (F.col("frame") + 1).alias("block"), F.col("map").alias("first"))
    joined = inside.withColumn("block", F.floor(F.col("frame") / block).cast("int")).join(before, [seq, "block"], "left")
    onward = F.when(F.col("first").isNull(), F.col("map")).otherwise(F.transform("first", lambda p: F.element_at("map", p + 1)))
    return joined.where("block = 0 OR first IS NOT NULL").select(seq, "frame", onward.alias("map"))


def tracks(frames: DataFrame, size: tuple[int, int], point: tuple[int, int], window: int, reach: tuple[int, int], seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """(seq, frame, y, x): where the feature at ``point`` of frame 0 lies in every frame that it can be followed to."""
    maps = next_places(frames, size, window, reach, seq)
    firsts = maps.groupBy(seq).agg(F.min("frame").alias("least")).where("least = 0").select(seq)
    gap = maps.select(seq, "frame").join(maps.select(seq, (F.col("frame") + 1).alias("frame")), [seq, "frame"], "left_anti").where("frame > 0").groupBy(seq).agg(F.min("frame").alias("gap"))
    whole = maps.join(firsts, seq).join(gap, seq, "left").where("gap IS NULL OR frame < gap").drop("gap")
    at = point[0] * size[1] + point[1]
    later = composed(whole, seq, block).select(seq, (F.col("frame") + 1).alias("frame"), F.element_at("map", at + 1).alias("p"))
    start = frames.where("frame = 0").select(F.col(seq).cast("long").alias(seq)).distinct().select(seq, F.lit(0).alias("frame"), F.lit(at).alias("p"))
    return start.unionByName(later).select(seq, "frame", F.floor(F.col("p") / size[1]).cast("int").alias("y"), (F.col("p") % size[1]).alias("x"))


def registered_mean(frames: DataFrame, found: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, y, x, v): mean of a sequence's tracked frames, each moved so that the feature stays in place; only places that all of them cover."""
    first = found.where("frame = 0").select(seq, F.col("y").alias("y0"), F.col("x").alias("x0"))
    shifts = found.join(first, seq).select(seq, "frame", (F.col("y0") - F.col("y")).alias("dy"), (F.col("x0") - F.col("x")).alias("dx"))
    number = shifts.groupBy(seq).agg(F.count("*").alias("all"))
    moved = frames.withColumn(seq, F.col(seq).cast("long")).join(shifts, [seq, "frame"]).select(seq, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")
    sums = moved.groupBy(seq, "y", "x").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return sums.join(number, seq).where(F.col("n") == F.col("all")).select(seq, "y", "x", "v")
