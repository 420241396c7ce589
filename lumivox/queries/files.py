"""Tables that go through files of the binary formats: sinks, then splittable sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox import grid
from lumivox.lineage import new_folder
from lumivox.queries import query
from lumivox.sources import binary, grids, records

ENDS = ", ".join(records.LINE_ENDS)
CUBE, SQUARE = (8, 8, 8), (8, 8)


@query(f"SELECT lor_id AS n, {ENDS} FROM lor", "lor")
def lines_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List-mode lines as groups of six files of 16-bit integers, and back by ranges of rows."""
    folder = new_folder(spark, "lines")
    records.write_lines(grid.lors(spark, sf_dir), folder, "lor_id")
    return records.read_lines(spark, folder)


@query(f"SELECT lor_id AS n, {', '.join(f'CAST({e} / 4.0 AS DOUBLE) AS {e}' for e in records.LINE_ENDS)} FROM lor", "lor")
def float_lines_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 32-bit floats."""
    folder = new_folder(spark, "lines")
    quarters = grid.lors(spark, sf_dir).select("lor_id", *((F.col(e) / 4).alias(e) for e in records.LINE_ENDS))
    records.write_lines(quarters, folder, "lor_id", "<f4")
    return records.read_lines(spark, folder, "<f4")


@query("SELECT lor_id AS n, c1, d1, c2, d2 FROM event", "event")
def ids_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coincidences as packed records of four 32-bit integers, and back."""
    folder = new_folder(spark, "ids")
    records.write_records(grid.detector_events(spark, sf_dir), folder, "c1:<i4,d1:<i4,c2:<i4,d2:<i4", "lor_id")
    return records.read_records(spark, folder, "c1:<i4,d1:<i4,c2:<i4,d2:<i4")


def keyed(read: DataFrame, key: str, axes: tuple[str, ...]) -> DataFrame:
    """Samples by the number in their file's name."""
    return read.select(F.regexp_extract("path", r"([0-9]+)\.\w+$", 1).cast("long").alias(key), *axes, "v")


DENSE = """SELECT g.volume_id, g.z, g.y, g.x, coalesce(v, CAST(0 AS DOUBLE)) AS v
    FROM (SELECT volume_id, CAST(a.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x FROM (SELECT DISTINCT volume_id FROM voxel), range(8) a(i), range(8) b(i), range(8) c(i)) g
    LEFT JOIN voxel w ON w.volume_id = g.volume_id AND w.z = g.z AND w.y = g.y AND w.x = g.x"""


@query(DENSE, "voxel")
def volume_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volume as a file with its sizes in front, and back by slabs; absent slices are 0."""
    folder = new_folder(spark, "volumes")
    grids.write_grids(grid.voxels(spark, sf_dir), folder, "volume_id", ("z", "y", "x"), CUBE, ".vol")
    return keyed(binary.read_volumes(spark, folder), "volume_id", ("z", "y", "x"))


@query(DENSE, "voxel")
def volume_raw_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volume as a bare file of 64-bit floats, and back."""
    folder = new_folder(spark, "volumes")
    grids.write_grids(grid.voxels(spark, sf_dir), folder, "volume_id", ("z", "y", "x"), CUBE, ".raw", header=False, dtype="<f8")
    return keyed(binary.read_raw_volumes(spark, folder, CUBE, "<f8"), "volume_id", ("z", "y", "x"))


@query("SELECT * FROM pixel", "pixel")
def image_write_im(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image as a file with its sizes in front, and back."""
    folder = new_folder(spark, "images")
    grids.write_grids(grid.pixels(spark, sf_dir), folder, "image_id", ("y", "x"), SQUARE, ".im")
    return keyed(binary.read_images(spark, folder), "image_id", ("y", "x"))
