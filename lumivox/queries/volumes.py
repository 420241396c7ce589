"""Queries on 8 x 8 x 8 volumes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumivox import grid as g
from lumivox.operators import samples as s
from lumivox.queries import query
from lumivox.queries.images import STATS, adaptive_sql, figures

ZYX = ("z", "y", "x")


def placed(name: str, z: str, y: str, x: str, where: str = "true"):
    @query(f"SELECT volume_id, CAST({z} AS INTEGER) AS z, CAST({y} AS INTEGER) AS y, CAST({x} AS INTEGER) AS x, v FROM voxel WHERE {where}", "voxel", name=name)
    def run(spark, sf_dir):
        return s.moved(g.voxels(spark, sf_dir).where(where), z=z, y=y, x=x)


placed("volume_rotate_x", "y", "7 - z", "x")
placed("volume_rotate_y", "x", "y", "7 - z")
placed("volume_rotate_z", "z", "x", "7 - y")
placed("volume_flip_ud", "z", "7 - y", "x")
placed("volume_unpack_cube", "z - 2", "y - 2", "x - 2", "z BETWEEN 2 AND 6 AND y BETWEEN 2 AND 6 AND x BETWEEN 2 AND 6")


@query("SELECT volume_id, y, x, v FROM voxel WHERE z = 3", "voxel")
def volume_slice(spark, sf_dir):
    return g.voxels(spark, sf_dir).where("z = 3").select("volume_id", "y", "x", "v")


def reduced(name: str, sql: str, how):
    @query(f"SELECT volume_id, y, x, round({sql}(v), 6) + 0.0 AS v FROM voxel GROUP BY ALL", "voxel", name=name)
    def run(spark, sf_dir):
        return s.project(g.voxels(spark, sf_dir), "volume_id", ["y", "x"], how).withColumn("v", g.rounded("v"))


reduced("volume_projection", "sum", F.sum)
reduced("volume_mip", "max", F.max)
reduced("volume_miip", "min", F.min)


@query(f"SELECT volume_id, {STATS} FROM voxel GROUP BY volume_id", "voxel")
def volume_infos(spark, sf_dir):
    return figures(s.statistics(g.voxels(spark, sf_dir), "volume_id"))


@query("SELECT volume_id, CAST((z // 3) * 8 + y AS INTEGER) AS y, CAST((z % 3) * 8 + x AS INTEGER) AS x, v FROM voxel", "voxel")
def volume_mosaic(spark, sf_dir):
    """Slices as tiles, three in a row."""
    return s.moved(g.voxels(spark, sf_dir), y="(z DIV 3) * 8 + y", x="(z % 3) * 8 + x").drop("z")


@query(
    "SELECT volume_id, CAST((z // 3) * 8 + y AS INTEGER) AS y, CAST((z % 3) * 8 + x AS INTEGER) AS x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) + 0.0 AS v FROM voxel WINDOW w AS (PARTITION BY volume_id, z)",
    "voxel",
)
def volume_mosaic_norm(spark, sf_dir):
    each = g.voxels(spark, sf_dir).withColumn("slice", F.struct("volume_id", "z"))
    return s.moved(s.min_max(each, "slice"), y="(z DIV 3) * 8 + y", x="(z % 3) * 8 + x").select("volume_id", "y", "x", g.rounded("v").alias("v"))


PACKED = (
    "SELECT volume_id, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT volume_id FROM voxel), range({n}) a(z), range({n}) b(y), range({n}) c(x) "
    "LEFT JOIN (SELECT volume_id, z + {d} AS z, y + {d} AS y, x + {d} AS x, v FROM voxel) p USING (volume_id, z, y, x)"
)


@query(PACKED.format(n=10, d=1).replace("FROM (SELECT DISTINCT", "FROM (SELECT * FROM (SELECT DISTINCT").replace(" LEFT JOIN", ") LEFT JOIN"), "voxel")
def volume_pack_center(spark, sf_dir):
    """Each volume in the middle of a 10 x 10 x 10 grid of zeros."""
    inner = s.moved(g.voxels(spark, sf_dir), z="z + 1", y="y + 1", x="x + 1")
    return g.dense(inner, spark, "volume_id", z=10, y=10, x=10)


@query("SELECT volume_id, round(corr(v1, v2), 6) + 0.0 AS zncc FROM vpair GROUP BY volume_id", "voxel", "vpair")
def volume_zncc(spark, sf_dir):
    return s.correlation(g.volume_pairs(spark, sf_dir), "volume_id").withColumn("zncc", g.rounded("zncc"))


@query("SELECT volume_id, CASE WHEN c >= 0 AND c < 1 THEN round(sqrt(c / (1 - c)), 6) + 0.0 END AS snr FROM (SELECT volume_id, corr(v1, v2) AS c FROM vpair GROUP BY volume_id)", "voxel", "vpair")
def volume_snr_from_zncc(spark, sf_dir):
    return s.correlation(g.volume_pairs(spark, sf_dir), "volume_id").select("volume_id", g.rounded(s.snr(F.col("zncc"))).alias("snr"))


CYLINDER = "(y - 4) * (y - 4) + (x - 4) * (x - 4) <= 9"


@query(
    f"SELECT volume_id, round(sum(a / d) * sqrt(2.0) / 5, 6) + 0.0 AS snr FROM (SELECT volume_id, z, avg((v1 + v2) / 2) AS a, stddev_samp(v1 - v2) AS d FROM vpair WHERE z BETWEEN 1 AND 5 AND {CYLINDER} GROUP BY volume_id, z) GROUP BY volume_id",
    "voxel", "vpair",
)
def volume_snr_from_lodge(spark, sf_dir):
    """Mean over sample deviation of the difference, slice by slice under a mask, slices 1 to 5."""
    mask = g.grid(spark, y=8, x=8).where(CYLINDER)
    pairs = g.volume_pairs(spark, sf_dir).where("z BETWEEN 1 AND 5").join(F.broadcast(mask), ["y", "x"], "left_semi")
    each = pairs.groupBy("volume_id", "z").agg(F.avg((F.col("v1") + F.col("v2")) / 2).alias("a"), F.stddev_samp(F.col("v1") - F.col("v2")).alias("d"))
    return each.groupBy("volume_id").agg(g.rounded(F.sum(F.try_divide("a", "d")) * F.sqrt(F.lit(2.0)) / 5).alias("snr"))


def masked(name: str, condition: str):
    @query(f"SELECT volume_id, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM voxel WHERE {condition} GROUP BY volume_id", "voxel", name=name)
    def run(spark, sf_dir):
        mask = g.grid(spark, z=8, y=8, x=8).where(condition)
        under = g.voxels(spark, sf_dir).join(F.broadcast(mask), list(ZYX), "left_semi")
        return under.groupBy("volume_id").agg(F.count("*").alias("n"), g.rounded(F.sum("v")).alias("total"))


masked("volume_mask_box", "abs(z - 4) <= 2 AND abs(y - 4) <= 1 AND abs(x - 4) <= 3")
masked("volume_mask_cylinder", f"{CYLINDER} AND abs(z - 4) <= 2")
masked("volume_mask_ball", "(z - 4) * (z - 4) + (y - 4) * (y - 4) + (x - 4) * (x - 4) <= 9")


@query(
    "SELECT a.volume_id, a.z, a.y, a.x, CASE WHEN a.z BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 AND count(*) = 27 THEN list_sort(list(b.v))[14] ELSE 0.0 END AS v "
    "FROM voxel a JOIN voxel b ON a.volume_id = b.volume_id AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.volume_id, a.z, a.y, a.x",
    "voxel",
)
def median_3d(spark, sf_dir):
    return s.median_filter(g.voxels(spark, sf_dir), "volume_id", ZYX, 3, (8, 8, 8))


@query(adaptive_sql("volume_id", "voxel", "zyx", 3, 5), "voxel")
def adaptive_median_3d(spark, sf_dir):
    """Adaptive median over windows of 3 and 5 voxels a side."""
    return s.adaptive_median(g.voxels(spark, sf_dir), "volume_id", ZYX, 3, 5, (8, 8, 8))


RESAMPLED = """
, tap AS (SELECT CAST(t AS INTEGER) AS t, CAST(k AS INTEGER) AS k, t * 8 / 12.0 - k AS d FROM range(12) a(t), range(8) b(k) WHERE k > floor(t * (8 / 12.0)) - {a} AND k <= floor(t * (8 / 12.0)) + {a}),
w AS (SELECT t, k, CASE WHEN abs(d) < 1e-12 THEN 1.0 ELSE sin(pi() * d) / (pi() * d) END * CASE WHEN abs(d) < 1e-12 THEN 1.0 ELSE sin(pi() * d / {a}) / (pi() * d / {a}) END AS w FROM tap)
SELECT volume_id, c.t AS z, a.t AS y, b.t AS x, round(sum(v * a.w * b.w * c.w), 6) + 0.0 AS v FROM voxel JOIN w a ON a.k = y JOIN w b ON b.k = x JOIN w c ON c.k = z GROUP BY volume_id, c.t, a.t, b.t
"""


@query(RESAMPLED.format(a=2), "voxel")
def resample_lanczos2_3d(spark, sf_dir):
    return s.lanczos(g.voxels(spark, sf_dir), "volume_id", ZYX, (8, 8, 8), (12, 12, 12), 2).select("volume_id", *ZYX, g.rounded("v").alias("v"))


@query(RESAMPLED.format(a=3), "voxel")
def resample_lanczos3_3d(spark, sf_dir):
    return s.lanczos(g.voxels(spark, sf_dir), "volume_id", ZYX, (8, 8, 8), (12, 12, 12), 3).select("volume_id", *ZYX, g.rounded("v").alias("v"))


@query(
    ", c AS (SELECT *, 4 * (v + 1) AS u FROM voxel), s AS (SELECT volume_id, y, x, sum(u * (CASE WHEN z = 3 THEN 6 WHEN z IN (2, 4) THEN 4 END) / 14) AS v FROM c WHERE z BETWEEN 2 AND 4 GROUP BY ALL) SELECT volume_id, y, x, round(v, 6) + 0.0 AS v FROM s",
    "voxel",
)
def flat_gaussian_z(spark, sf_dir):
    """The 4-6-4 smoothing along z at slice 3."""
    lifted = g.voxels(spark, sf_dir).where("z BETWEEN 2 AND 4").withColumn("v", 4 * (F.col("v") + 1))
    weight = F.when(F.col("z") == 3, 6).otherwise(4) / 14
    return lifted.groupBy("volume_id", "y", "x").agg(g.rounded(F.sum(F.col("v") * weight)).alias("v"))


def surface_rays(alpha: float, beta: float, size: int = 8, scale: float = 1.0) -> list[list[str]]:
    """Steps from (py, px) of an image to points (i, z, y, x) on its rays through a volume, as expressions of both dialects.

    The volume lies in the middle of a world twice the image's width; a ray is turned by
    two angles, cut to the volume's box, and followed in steps of its longest axis. An
    end on the far face moves to the last voxel.
    """
    number = lambda x: f"CAST({x!r} AS DOUBLE)"
    ca, sa, cb, sb = math.cos(alpha), math.sin(alpha), math.cos(beta), math.sin(beta)
    far, mid, pad = math.sqrt(2 * size * size) + 1, float(size), size / 2
    turned = {"x": (ca, 0.0, sa), "y": (sb * sa, cb, -sb * ca), "z": (-sa * cb, sb, cb * ca)}
    ends = [
        f"{number(mid)} + (px - {size // 2}) * {number(scale * u)} + (py - {size // 2}) * {number(scale * v)} + {number(sign * far * w)} AS {a}{i}"
        for i, sign in ((1, -1), (2, 1)) for a, (u, v, w) in turned.items()
    ]
    gaps = [f"CASE WHEN {a}2 = {a}1 THEN {number(1e-10)} ELSE {a}2 - {a}1 END AS d{a}" for a in "xyz"]
    sides = {a: (f"({number(pad)} - {a}1) / d{a}", f"({number(pad + size)} - {a}1) / d{a}") for a in "xyz"}
    near = "greatest(" + ", ".join(f"least({p}, {q})" for p, q in sides.values()) + ") AS t1"
    away = "least(" + ", ".join(f"greatest({p}, {q})" for p, q in sides.values()) + ") AS t2"
    met = [f"round({a}1 + d{a} * t{i}, 9) - {number(pad)} AS {a}{i}" for i in (1, 2) for a in "xyz"]
    held = [f"CASE WHEN floor({a}{i} + {number(0.5)}) = {size} THEN {number(size - 1.0)} ELSE {a}{i} END AS {a}{i}" for i in (1, 2) for a in "xyz"]
    count = "CAST(greatest(" + ", ".join(f"floor(abs({a}2 - {a}1))" for a in "xyz") + ") AS INTEGER) AS n"
    places = [f"CAST(floor(round({a}1 + {number(0.5)} + CASE WHEN n = 0 THEN {number(0.0)} ELSE i * ({a}2 - {a}1) / n END, 9)) AS INTEGER) AS {a}" for a in "zyx"]
    return [["py", "px", *ends], ["*", *gaps], ["*", near, away], ["py", "px", "t1", "t2", *met], ["py", "px", "t1", "t2", *held], ["*", count], ["py", "px", "i", *places]]


RAYS = surface_rays(0.6, 0.35)
INSIDE = "t1 <= t2 AND " + " AND ".join(f"{a}{i} BETWEEN 0 AND 8" for a in "xyz" for i in (1, 2))


def surface_sql() -> str:
    names, out = "abcdef", [f", a AS (SELECT {', '.join(RAYS[0])} FROM range(8) r(py), range(8) c(px))"]
    for last, name, columns in zip(names, names[1:], RAYS[1:]):
        out.append(f", {name} AS (SELECT {', '.join(columns)} FROM {last}{' WHERE ' + INSIDE if name == 'e' else ''})")
    return "".join(out) + f", g AS (SELECT {', '.join(RAYS[-1])} FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM f)) "


@query(surface_sql() + "SELECT volume_id, CAST(py AS INTEGER) AS y, CAST(px AS INTEGER) AS x, CAST(min(i) AS INTEGER) AS step, arg_min(v, i) AS v FROM g JOIN voxel USING (z, y, x) WHERE v > 0.1 GROUP BY volume_id, py, px", "voxel")
def volume_surf(spark, sf_dir):
    """First value above a threshold along the rays of an 8 x 8 image seen from two angles; rays without any are left out.

    The rays' points depend on the image alone; they are few and meet the voxels by a broadcast.
    """
    rays = g.grid(spark, py=8, px=8)
    for n, columns in enumerate(RAYS[:-1]):
        rays = (rays.where(INSIDE) if n == 4 else rays).selectExpr(*columns)
    points = rays.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).selectExpr(*RAYS[-1])
    met = g.voxels(spark, sf_dir).where("v > 0.1").join(F.broadcast(points), list(ZYX))
    first = met.groupBy("volume_id", "py", "px").agg(F.min("i").alias("step"), F.min_by("v", "i").alias("v"))
    return first.select("volume_id", F.col("py").alias("y"), F.col("px").alias("x"), "step", "v")


@query(
    "SELECT volume_id, y, CAST(floor((40 + (x - 4) * 8 + (z - 4) * 6) / 10) AS INTEGER) AS x, round(max(v), 6) + 0.0 AS v FROM voxel GROUP BY volume_id, y, CAST(floor((40 + (x - 4) * 8 + (z - 4) * 6) / 10) AS INTEGER)",
    "voxel",
)
def volume_mip_angle(spark, sf_dir):
    """Maximum intensity seen from an angle about y whose cosine is 0.8."""
    turned = s.moved(g.voxels(spark, sf_dir), x="floor((40 + (x - 4) * 8 + (z - 4) * 6) / 10)")
    return s.project(turned, "volume_id", ["y", "x"], F.max).withColumn("v", g.rounded("v"))
