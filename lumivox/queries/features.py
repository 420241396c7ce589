"""Queries on corners, tracked frames, cubes and inverse transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox import grid as g
from lumivox.operators import features, tracking
from lumivox.operators import samples as s
from lumivox.operators import spectral as f
from lumivox.queries import ORACLE_SQL, SHARED, query
from lumivox.queries.spectra import TRANSFERS, ZYX, cube

#: Sheets of 64 embeddings, one a row.
SHEET = "sheet AS (SELECT vec_id // 64 AS sheet_id, CAST(vec_id % 64 AS INTEGER) AS y, CAST(p - 1 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(p))"
CORNERS = f"""WITH {SHEET}, extent AS (SELECT sheet_id, max(y) + 1 AS h, max(x) + 1 AS w FROM sheet GROUP BY sheet_id),
    steps AS (
        SELECT a.sheet_id, a.y, a.x, sum(b.v * (b.x - a.x)) AS gx, sum(b.v * (b.y - a.y)) AS gy FROM sheet a JOIN extent e USING (sheet_id) JOIN sheet b ON b.sheet_id = a.sheet_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1
        WHERE a.y BETWEEN 1 AND h - 2 AND a.x BETWEEN 1 AND w - 2 GROUP BY a.sheet_id, a.y, a.x),
    sums AS (
        SELECT a.sheet_id, a.y, a.x, sum(gx * gx * bell) AS xx, sum(gy * gy * bell) AS yy, sum(gx * gy * bell) AS xy
        FROM sheet a JOIN extent e USING (sheet_id) JOIN (SELECT sheet_id, y + CAST(i AS INTEGER) AS y, x + CAST(j AS INTEGER) AS x, gx, gy, exp(-(i * i + j * j) / 8.0) AS bell FROM steps, range(-6, 7) r(i), range(-6, 7) q(j)) b ON b.sheet_id = a.sheet_id AND b.y = a.y AND b.x = a.x
        WHERE a.y BETWEEN 6 AND h - 7 AND a.x BETWEEN 6 AND w - 7 GROUP BY a.sheet_id, a.y, a.x),
    raw AS (SELECT s.sheet_id, s.y, s.x, coalesce(xx * yy - xy * xy - 0.04 * (xx + yy) * (xx + yy), CAST(0 AS DOUBLE)) AS m FROM sheet s LEFT JOIN sums USING (sheet_id, y, x)),
    scaled AS (SELECT *, (m - min(m) OVER w) / nullif(max(m) OVER w - min(m) OVER w, 0) * 255 AS v FROM raw WINDOW w AS (PARTITION BY sheet_id)),
    rows_most AS (SELECT sheet_id, y, x, v, max(v) OVER (PARTITION BY sheet_id, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS vx FROM scaled),
    most AS (SELECT *, max(vx) OVER (PARTITION BY sheet_id, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM rows_most),
    corner AS (SELECT sheet_id, y, x, v FROM most JOIN extent USING (sheet_id) WHERE v = top AND v > 0 AND y BETWEEN 3 AND h - 4 AND x BETWEEN 3 AND w - 4)"""


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.table(spark, sf_dir, "embeddings").select(F.expr("vec_id DIV 64").alias("sheet_id"), (F.col("vec_id") % 64).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("sheet_id", "y", "x", F.col("v").cast("double").alias("v"))


@query(CORNERS + " SELECT sheet_id, y, x, round(v, 4) + 0.0 AS v FROM corner")
def harris_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed Harris responses of sheets."""
    return features.corners(sheets(spark, sf_dir), "sheet_id").select("sheet_id", "y", "x", g.rounded("v", 4).alias("v"))


@query(CORNERS + " SELECT sheet_id, y, x, round(v, 4) + 0.0 AS v FROM corner WHERE v >= 60")
def harris_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners with a response above a given one."""
    return features.above(features.corners(sheets(spark, sf_dir), "sheet_id"), 60).select("sheet_id", "y", "x", g.rounded("v", 4).alias("v"))


@query(
    CORNERS + ", level AS (SELECT sheet_id, CAST(th AS INTEGER) AS th, count(*) FILTER (v >= th) AS n FROM corner, range(1, 256) t(th) GROUP BY sheet_id, th), chosen AS (SELECT sheet_id, coalesce(min(th) FILTER (n <= 20), 0) AS threshold FROM level GROUP BY sheet_id) "
    "SELECT sheet_id, threshold, y, x, round(v, 4) + 0.0 AS v FROM corner JOIN chosen USING (sheet_id) WHERE v >= threshold"
)
def harris_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best corners of each sheet, twenty at most, by a threshold of its own."""
    return features.at_most(features.corners(sheets(spark, sf_dir), "sheet_id"), "sheet_id", 20).select("sheet_id", "threshold", "y", "x", g.rounded("v", 4).alias("v"))


#: Sequences of up to 16 images; a feature near the middle is followed by windows of 3 pixels and steps of 1.
TRACKED = """, frames AS (SELECT image_id // 16 AS seq, CAST(image_id % 16 AS INTEGER) AS frame, y, x, v FROM pixel),
    near AS (SELECT a.seq, a.frame, a.y, a.x, p.y - a.y AS dy, p.x - a.x AS dx, p.v FROM frames a JOIN frames p ON p.seq = a.seq AND p.frame = a.frame AND abs(p.y - a.y) <= 1 AND abs(p.x - a.x) <= 1 WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6),
    later AS (SELECT seq, frame - 1 AS frame, y AS y2, x AS x2, dy, dx, v AS w FROM near),
    shifts AS (SELECT a.seq, a.frame, y, x, y2, x2, round(sum((v - w) * (v - w)), 9) AS apart FROM near a JOIN later b ON a.seq = b.seq AND a.frame = b.frame AND a.dy = b.dy AND a.dx = b.dx WHERE abs(y2 - y) <= 1 AND abs(x2 - x) <= 1 GROUP BY a.seq, a.frame, y, x, y2, x2),
    best AS (SELECT seq, frame, y, x, arg_min(y2, {'d': apart, 'y': y2, 'x': x2}) AS y2, arg_min(x2, {'d': apart, 'y': y2, 'x': x2}) AS x2 FROM shifts GROUP BY seq, frame, y, x),
    track AS (SELECT DISTINCT seq, 0 AS frame, 4 AS y, 4 AS x FROM frames WHERE frame = 0 UNION ALL SELECT t.seq, t.frame + 1, b.y2, b.x2 FROM track t JOIN best b ON b.seq = t.seq AND b.frame = t.frame AND b.y = t.y AND b.x = t.x)"""


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.pixels(spark, sf_dir).select(F.expr("image_id DIV 16").alias("seq"), (F.col("image_id") % 16).cast("int").alias("frame"), "y", "x", "v")


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.tracks(frames_of(spark, sf_dir), (8, 8), (4, 4), 3, (1, 1), block=4)


@query("WITH RECURSIVE " + SHARED["pixel"] + TRACKED + " SELECT seq, frame, y, x FROM track")
def track_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a feature of the first frame goes, frame by frame."""
    return tracked(spark, sf_dir)


@query("WITH RECURSIVE " + SHARED["pixel"] + TRACKED + """, number AS (SELECT seq, count(*) AS n FROM track GROUP BY seq)
    SELECT f.seq, f.y + 4 - t.y AS y, f.x + 4 - t.x AS x, round(avg(f.v), 6) + 0.0 AS v FROM frames f JOIN track t USING (seq, frame) JOIN number USING (seq) GROUP BY f.seq, f.y + 4 - t.y, f.x + 4 - t.x HAVING count(*) = any_value(n)""")
def reg_ave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each sequence's frames, brought into line by the feature, where all of them cover it."""
    return tracking.registered_mean(frames_of(spark, sf_dir), tracked(spark, sf_dir)).select("seq", "y", "x", g.rounded("v").alias("v"))


@query(
    "SELECT g.volume_id, g.z, g.y, g.x, round(coalesce(abs(v), 0), 6) + 0.0 AS v FROM (SELECT volume_id, CAST(a.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x FROM (SELECT DISTINCT volume_id FROM voxel), range(8) a(i), range(8) b(i), range(8) c(i)) g "
    "LEFT JOIN voxel w ON w.volume_id = g.volume_id AND w.z = g.z AND w.y = g.y AND w.x = g.x",
    "voxel",
)
def volume_ifft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moduli of volumes that went to frequencies and back."""
    return f.transformed(cube(spark, sf_dir), "volume_id", ZYX, 8, inverse=True).withColumn("v", g.rounded("v"))


FLAT = "flat AS (SELECT vec_id // 4 AS volume_id, CAST(vec_id % 4 AS INTEGER) AS z, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(p))"


@query(
    f"WITH {FLAT} SELECT g.volume_id, g.z, g.y, g.x, coalesce(v, CAST(0 AS DOUBLE)) AS v FROM (SELECT volume_id, CAST(a.i AS INTEGER) AS z, CAST(b.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x FROM (SELECT DISTINCT volume_id FROM flat), range(8) a(i), range(8) b(i), range(8) c(i)) g "
    "LEFT JOIN flat w ON w.volume_id = g.volume_id AND w.z + 2 = g.z AND w.y = g.y AND w.x = g.x"
)
def volume_pack_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of four slices in the middle of a cube of their longest edge."""
    pixels = g.pixels(spark, sf_dir)
    flat = pixels.select(F.expr("image_id DIV 4").alias("volume_id"), (F.col("image_id") % 4).cast("int").alias("z"), "y", "x", "v")
    return s.packed_cube(flat, spark, "volume_id", (4, 8, 8))


@query("SELECT volume_id, z, y, x, CASE WHEN (y - 4) * (y - 4) + (x - 4) * (x - 4) <= 9 AND abs(z - 4) <= 3 THEN v ELSE 0.0 END AS v FROM (" + ORACLE_SQL["filter_3d_metz"] + ")")
def magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline for a volume: the Metz filter, then a cylinder outside which all is 0."""
    filtered = f.filtered(g.voxels(spark, sf_dir), "volume_id", ZYX, 8, TRANSFERS["metz"][0]).withColumn("v", g.rounded("v"))
    inside = F.expr("(y - 4) * (y - 4) + (x - 4) * (x - 4) <= 9 AND abs(z - 4) <= 3")
    return filtered.withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))
