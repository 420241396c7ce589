"""Queries on lines with real ends, voxel by voxel, and on matrices that stay on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox import grid as g
from lumivox.jobs import reconstruction as r
from lumivox.jobs.stored import StoredMatrix
from lumivox.operators.traversal import ENDS, path_segments, ray_segments
from lumivox.queries import query
from lumivox.queries.reconstruction import GRID, mumap, norms, start
from lumivox.queries.systems import EXACT, siddon_step

#: Six numbers in [0, 1) per line, by which its ends lie within their voxels.
REAL = ", real AS (SELECT lor_id, " + ", ".join(f"{e} + CAST(((lor_id * 6 + {k}) * 1103515245 + 12345) % 2147483648 AS DOUBLE) / 2147483648.0 AS {e}" for k, e in enumerate(ENDS)) + " FROM lor)"
#: Where lines of ``real`` cross planes, as shares of their length, and the segments between.
CROSSED = """, crossed AS (
    SELECT real.*, a FROM real, range(1, 33) t(k), (VALUES (0), (1), (2)) ax(i),
        LATERAL (SELECT CASE i WHEN 0 THEN (k - x1) / nullif(x2 - x1, 0) WHEN 1 THEN (k - y1) / nullif(y2 - y1, 0) ELSE (k - z1) / nullif(z2 - z1, 0) END AS a) q WHERE a > 0 AND a < 1
    UNION SELECT *, 0.0 FROM real UNION SELECT *, 1.0 FROM real),
parts AS (SELECT *, lag(a) OVER (PARTITION BY lor_id ORDER BY a) AS b, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)) AS length FROM crossed),
segments AS (
    SELECT lor_id, (a - b) * length AS w, CAST(floor(z1 + (a + b) / 2 * (z2 - z1)) * 1024 + floor(y1 + (a + b) / 2 * (y2 - y1)) * 32 + floor(x1 + (a + b) / 2 * (x2 - x1)) AS BIGINT) AS vox
    FROM parts WHERE (a - b) * length > 1e-9)
"""


def real_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = lambda k: F.pmod((F.col("lor_id") * 6 + k) * F.lit(1103515245) + 12345, F.lit(2147483648)).cast("double") / 2147483648.0
    return g.lors(spark, sf_dir).select("lor_id", *((F.col(e) + shift(k)).alias(e) for k, e in enumerate(ENDS)))


@query(REAL + CROSSED + "SELECT lor_id, vox, round(w, 6) + 0.0 AS w FROM segments WHERE w > 1e-6", "lor")
def amanatides_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of each line from its real entry to its end, with the length in each."""
    return path_segments(real_lines(spark, sf_dir), GRID).where("w > 1e-6").select("lor_id", "vox", g.rounded("w").alias("w"))


@query(REAL + CROSSED + "SELECT vox, round(sum(w), 5) + 0.0 AS v FROM segments GROUP BY vox HAVING sum(w) > 1e-5", "lor")
def amanatides_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lengths, added up in a volume."""
    sums = path_segments(real_lines(spark, sf_dir), GRID).groupBy("vox").agg(F.sum("w").alias("v")).where("v > 1e-5")
    return sums.select("vox", g.rounded("v", 5).alias("v"))


#: Rays from each line's entry along its direction; their distance leaves out a share of the end.
RAYS = """, ray_real AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)) AS l, 0.25 + (lor_id % 8) * 0.09375 AS part FROM real0),
real AS (SELECT lor_id, x1, y1, z1, x1 + (x2 - x1) / l * (l * part) AS x2, y1 + (y2 - y1) / l * (l * part) AS y2, z1 + (z2 - z1) / l * (l * part) AS z2 FROM ray_real)"""


def real_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = real_lines(spark, sf_dir)
    length = F.sqrt(sum((F.col(f"{a}2") - F.col(f"{a}1")) * (F.col(f"{a}2") - F.col(f"{a}1")) for a in "xyz"))
    lines = lines.withColumn("l", length)
    return lines.select("lor_id", "x1", "y1", "z1", *(((F.col(f"{a}2") - F.col(f"{a}1")) / F.col("l")).alias(f"d{a}") for a in "xyz"), (F.col("l") * (0.25 + F.col("lor_id") % 8 * 0.09375)).alias("d"))


@query(REAL.replace("real AS", "real0 AS") + RAYS + CROSSED + "SELECT vox, round(sum(w), 5) + 0.0 AS v FROM segments GROUP BY vox HAVING sum(w) > 1e-5", "lor")
def raypro_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays given by point, direction and distance, added up in a volume."""
    sums = ray_segments(real_rays(spark, sf_dir), GRID).groupBy("vox").agg(F.sum("w").alias("v")).where("v > 1e-5")
    return sums.select("vox", g.rounded("v", 5).alias("v"))


@query(REAL.replace("real AS", "real0 AS") + RAYS + "SELECT r.lor_id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)), 5) + 0.0 AS d FROM real r", "lor")
def raypro_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of each ray add up to its distance."""
    return ray_segments(real_rays(spark, sf_dir), GRID).groupBy("lor_id").agg(g.rounded(F.sum("w"), 5).alias("d"))


def stored(spark: SparkSession, sf_dir: str) -> StoredMatrix:
    return StoredMatrix(r.rays_of(g.lors(spark, sf_dir), GRID, "lengths"))


@query(EXACT + siddon_step(1, "im0") + siddon_step(2, "im1") + " SELECT vox, round(v, 5) + 0.0 AS v FROM im2", "lor")
def mlem_siddon_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two EM steps with exact path lengths from a matrix that is computed once and stays on disk."""
    return stored(spark, sf_dir).em(start(spark), 2).select("vox", g.rounded("v", 5).alias("v"))


@query(EXACT + siddon_step(1, "im0", 0.5, norm=True) + " SELECT vox, round(v, 5) + 0.0 AS v FROM im1", "lor")
def mlem_siddon_stored_attenuated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One such step, attenuated and normalised."""
    return stored(spark, sf_dir).em(start(spark), 1, norm=norms(spark), mu=mumap(spark), scale=0.5).select("vox", g.rounded("v", 5).alias("v"))


@query(EXACT + siddon_step(1, "im0", 0.5) + " SELECT vox, round(v, 5) + 0.0 AS v FROM im1", "lor")
def lmem_joined_attenuated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step's plan for grids of which no task holds an image: lines, image and map are joined as tables."""
    return r.em_step(g.lors(spark, sf_dir), start(spark), GRID, mumap(spark), 0.5, weights="lengths", most_cells=0).select("vox", g.rounded("v", 5).alias("v"))
