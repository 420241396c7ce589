"""Logical tables: adapters from the given tables, and dense grids.

pixel(image_id, y, x, v), voxel(volume_id, z, y, x, v), lor(lor_id, x1..z2) and
event(lor_id, c1, d1, c2, d2) are long tables with one row per sample; a missing
sample is not zero, so operators that need a full grid ask for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The small reconstruction grid of the adapters.
NX, NY, NZ = 32, 32, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 image."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v"))
    return rows.select("image_id", F.expr("CAST(p DIV 8 AS INT)").alias("y"), (F.col("p") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each eight images in the order of vec_id as slices of an 8 x 8 x 8 volume; where an id is missing, so is its slice."""
    place = [F.expr("vec_id DIV 8").alias("volume_id"), (F.col("vec_id") % 8).cast("int").alias("z")]
    rows = table(spark, sf_dir, "embeddings").select(*place, F.posexplode("embedding").alias("p", "v"))
    return rows.select("volume_id", "z", F.expr("CAST(p DIV 8 AS INT)").alias("y"), (F.col("p") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair(image_id, y, x, v1, v2): each image beside the next one."""
    first = pixels(spark, sf_dir)
    second = first.select((F.col("image_id") - 1).alias("image_id"), "y", "x", F.col("v").alias("v2"))
    return first.withColumnRenamed("v", "v1").join(second, ["image_id", "y", "x"])


def volume_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = voxels(spark, sf_dir)
    second = first.select((F.col("volume_id") - 1).alias("volume_id"), "z", "y", "x", F.col("v").alias("v2"))
    return first.withColumnRenamed("v", "v1").join(second, ["volume_id", "z", "y", "x"])


def lors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of response on the 32 x 32 x 8 grid, one per order, with ``len`` steps."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS lor_id",
        "CAST(o_orderkey % 32 AS INT) AS x1", "CAST(o_custkey % 32 AS INT) AS y1", "CAST((o_orderkey * 3 + o_custkey) % 8 AS INT) AS z1",
        "CAST((o_orderkey * 7 + 11) % 32 AS INT) AS x2", "CAST((o_custkey * 5 + 3) % 32 AS INT) AS y2", "CAST((o_orderkey + o_custkey * 3 + 1) % 8 AS INT) AS z2",
    )
    return rows.withColumn("len", F.greatest(*(F.abs(F.col(f"{a}2") - F.col(f"{a}1")) for a in "xyz")))


def detector_events(spark: SparkSession, sf_dir: str, crystals: int = 638, detectors: int = 28) -> DataFrame:
    """Coincidences as crystal and detector ids, one per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS lor_id", f"CAST(o_orderkey % {crystals} AS INT) AS c1", f"CAST(o_custkey % {detectors} AS INT) AS d1",
        f"CAST((o_orderkey * 7 + 11) % {crystals} AS INT) AS c2", f"CAST((o_custkey * 5 + 3) % {detectors} AS INT) AS d2",
    )


def grid(spark: SparkSession, **sizes: int) -> DataFrame:
    """All places of a grid, one integer column per axis, the last axis fastest."""
    total, place, columns = 1, F.col("id"), []
    for axis, n in reversed(sizes.items()):
        columns.insert(0, F.expr(f"CAST((id DIV {total}) % {n} AS INT)").alias(axis))
        total *= n
    return spark.range(total).select(*columns)


def dense(samples: DataFrame, spark: SparkSession, key: str, **sizes: int) -> DataFrame:
    """Every key's samples on the full grid, 0 where there was none.

    The grid is bounded by its sizes, not by the data, and is small enough to be
    explode-generated beside each key.
    """
    axes = list(sizes)
    places = samples.select(key).distinct()
    for axis, n in sizes.items():
        places = places.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return places.join(samples, [key, *axes], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def rounded(value: Column | str, places: int = 6) -> Column:
    """Rounded for comparison; a negative zero becomes zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, places) + F.lit(0.0)
