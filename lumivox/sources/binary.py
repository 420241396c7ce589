"""Binary formats: images, volumes, raw volumes, id records, lines of list mode, phase space, simulator text.

Images and volumes are read by slabs (``grids``), records by ranges of rows
(``records``), so a file may be of any size; both have writers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.sources.grids import read_grids
from lumivox.sources.records import fields_of, read_lines, read_records

__all__ = ["read_lines"]
#: Fixed value: the packed record of phase space files; the last two numbers are unused.
PHASE_SPACE = np.dtype([("type", "<i1"), *((c, "<f4") for c in ("E", "px", "py", "pz", "dx", "dy", "dz", "u1", "u2"))])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Float images: height and width in front."""
    return read_grids(spark, path, ("y", "x"))


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Float volumes: depth, height and width in front."""
    return read_grids(spark, path, ("z", "y", "x"))


def read_raw_volumes(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "<f4") -> DataFrame:
    """Volumes without a header; shape and type are the caller's."""
    return read_grids(spark, path, ("z", "y", "x"), shape, dtype)


def read_id_records(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(path, n, c1, d1, c2, d2) of files of four 32-bit integers a record."""
    names = ["c1", "d1", "c2", "d2"]
    return read_records(spark, path, fields_of(dict.fromkeys(names, "<i4")), named=True, start=start, stop=stop).select("path", "n", *names)


def in_order(lines: DataFrame, order: DataFrame) -> DataFrame:
    """(place, n, ends..): the lines that ``order`` (place, n) names, to be taken in the order of ``place``; a line may be named twice."""
    return order.join(lines, "n")


def read_phase_space(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, type, E, px, py, pz, dx, dy, dz) of packed records of 37 bytes."""
    names = PHASE_SPACE.names[:-2]
    fields = ",".join(f"{'' if c in names else '_'}{c}:{PHASE_SPACE[c].str}" for c in PHASE_SPACE.names)
    return read_records(spark, path, fields, named=True).select("path", "n", *names)


def encoded(samples: DataFrame, key: str, axes: tuple[str, ...], shape: tuple[int, ...], header: bool = True) -> DataFrame:
    """(key, content): the bytes of each image or volume; missing samples are 0.

    One key's grid is one group; its size is that of the shape, which must fit a task.
    """

    def run(rows: pa.Table) -> pa.Table:
        cube = np.zeros(shape, "<f4")
        cube[tuple(rows.column(a).to_numpy() for a in axes)] = rows.column("v").to_numpy()
        content = (np.array(shape, "<f4").tobytes() if header else b"") + cube.tobytes()
        return pa.table([rows.column(key)[:1].cast(pa.int64()), pa.array([content], pa.binary())], [key, "content"])

    return samples.select(F.col(key).cast("long").alias(key), *axes, "v").groupBy(key).applyInArrow(run, f"{key} long, content binary")


def read_coincidences(spark: SparkSession, path: str) -> DataFrame:
    """Simulator text: columns 15, 12, 38 and 35 of lines parted by white space are c1, d1, c2, d2."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(words.alias("w")).where(F.size("w") > 38)
    return lines.select(*(F.element_at("w", at + 1).try_cast("int").alias(name) for name, at in (("c1", 15), ("d1", 12), ("c2", 38), ("d2", 35))))
