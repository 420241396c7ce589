"""Reconstruction queries on the 32 x 32 x 8 grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumivox import grid as g
from lumivox.functions import scanner as sc
from lumivox.jobs import reconstruction as r
from lumivox.queries import query, shared

GRID, CELLS = (g.NX, g.NY, g.NZ), g.NX * g.NY * g.NZ
START = "im0 AS (SELECT CAST(i AS INTEGER) AS vox, 1.0::DOUBLE AS v FROM range(8192) t(i))"
MU = "mu AS (SELECT vox, (vox % 7) * 0.001::DOUBLE AS mu FROM im0)"
NORM = "nm AS (SELECT vox, 1 + (vox % 5) * 0.1::DOUBLE AS norm FROM im0)"


def rays(spark, sf_dir):
    return sc.samples_of(g.lors(spark, sf_dir), g.NX, g.NY).withColumn("w", F.lit(1.0))


def start(spark):
    return spark.range(CELLS).select(F.col("id").cast("int").alias("vox"), F.lit(1.0).alias("v"))


def mumap(spark):
    return start(spark).select("vox", ((F.col("vox") % 7) * F.lit(0.001)).alias("mu"))


def norms(spark):
    return start(spark).select("vox", (1 + (F.col("vox") % 5) * F.lit(0.1)).alias("norm"))


def step(n: int, source: str, image: str, scale: float | None = None, where: str = "true", norm: bool = False) -> str:
    """CTEs of one EM step from ``image`` to ``im<n>``."""
    q = f"sum(v) * exp(-{scale} * sum(mu))" if scale else "sum(v)"
    join = " JOIN mu USING (vox)" if scale else ""
    factor = "coalesce(f, 0) / norm" if norm else "coalesce(f, 0)"
    nm = " JOIN nm USING (vox)" if norm else ""
    return (
        f"part{n} AS (SELECT * FROM {source} WHERE {where}), q{n} AS (SELECT lor_id, {q} AS q FROM part{n} JOIN {image} USING (vox){join} GROUP BY lor_id), "
        f"f{n} AS (SELECT vox, sum(1 / q) AS f FROM part{n} JOIN q{n} USING (lor_id) WHERE q <> 0 GROUP BY vox), im{n} AS (SELECT vox, v * {factor} AS v FROM {image} LEFT JOIN f{n} USING (vox){nm})"
    )


def sql(*ctes: str, last: str) -> str:
    return ", ".join([shared("lor", "ray").strip(), START, *ctes]) + f" SELECT vox, round(v, 6) + 0.0 AS v FROM {last}"


def out(image):
    return image.select("vox", g.rounded("v").alias("v"))


@query(sql(step(1, "ray", "im0"), last="im1"))
def lmem_iteration(spark, sf_dir):
    """One list-mode EM iteration over all lines."""
    return out(r.em_step(g.lors(spark, sf_dir), start(spark), GRID))


@query(sql(MU, step(1, "ray", "im0", 0.5), last="im1"))
def lmem_attenuated(spark, sf_dir):
    return out(r.em_step(g.lors(spark, sf_dir), start(spark), GRID, mumap(spark), 0.5))


HALVES = ("lor_id % 2 = 0", "lor_id % 2 = 1")


@query(sql(step(1, "ray", "im0", where=HALVES[0]), step(2, "ray", "im1", where=HALVES[1]), last="im2"))
def osem_2subsets(spark, sf_dir):
    return out(r.ordered_subsets(g.lors(spark, sf_dir), start(spark), F.col("lor_id") % 2, 2, GRID))


@query(sql(NORM, step(1, "ray", "im0", where=HALVES[0], norm=True), step(2, "ray", "im1", where=HALVES[1], norm=True), last="im2"))
def oplem_2subsets(spark, sf_dir):
    return out(r.ordered_subsets(g.lors(spark, sf_dir), start(spark), F.col("lor_id") % 2, 2, GRID, norm=norms(spark)))


@query(sql(NORM, MU, step(1, "ray", "im0", 0.3333, HALVES[0], True), step(2, "ray", "im1", 0.3333, HALVES[1], True), last="im2"))
def oplem_att(spark, sf_dir):
    return out(r.ordered_subsets(g.lors(spark, sf_dir), start(spark), F.col("lor_id") % 2, 2, GRID, norm=norms(spark), mu=mumap(spark), scale=0.3333))


@query(
    sql(
        "cnt AS (SELECT o_orderkey AS lor_id, 1 + o_orderkey % 3 AS n FROM orders), q1 AS (SELECT lor_id, sum(v) AS q FROM ray JOIN im0 USING (vox) GROUP BY lor_id), "
        "sens AS (SELECT vox, count(*) AS norm FROM ray GROUP BY vox), f1 AS (SELECT vox, sum(n / q) AS f FROM ray JOIN q1 USING (lor_id) JOIN cnt USING (lor_id) GROUP BY vox), "
        "im1 AS (SELECT vox, coalesce(v * coalesce(f, 0) / norm, 0) AS v FROM im0 LEFT JOIN f1 USING (vox) LEFT JOIN sens USING (vox))",
        last="im1",
    )
)
def mlem_binned(spark, sf_dir):
    """Binned EM: lines carry counts, and voxels their sensitivity."""
    lines = g.lors(spark, sf_dir).withColumn("n", 1 + F.col("lor_id") % 3)
    sensitivity = r.back_by_lines(lines, GRID).withColumnRenamed("f", "norm")
    return out(r.update(start(spark), r.back_by_lines(lines, GRID, r.gathered(start(spark), CELLS), count="n"), sensitivity))


@query(shared("lor", "ray") + "SELECT vox, round(sum(1.0 / len), 6) + 0.0 AS v FROM ray JOIN lor USING (lor_id) GROUP BY vox")
def sensitivity(spark, sf_dir):
    """Each line spreads one count over its voxels."""
    lines = g.lors(spark, sf_dir)
    own = sc.samples_of(lines, g.NX, g.NY)
    return own.join(lines.select("lor_id", "len"), "lor_id").groupBy("vox").agg(g.rounded(F.sum(1 / F.col("len"))).alias("v"))


@query(shared("lor", "ray") + "SELECT lor_id, round(sum((vox % 7) * 0.001::DOUBLE), 6) + 0.0 AS v FROM ray GROUP BY lor_id")
def forward_projection(spark, sf_dir):
    seen = r.forward(rays(spark, sf_dir), mumap(spark).withColumnRenamed("mu", "v"))
    missing = g.lors(spark, sf_dir).where("len > 0").select("lor_id").join(seen, "lor_id", "left")
    return missing.select("lor_id", g.rounded(F.coalesce("q", F.lit(0.0))).alias("v"))


@query(shared("lor", "ray") + "SELECT vox, count(DISTINCT lor_id) AS n FROM ray GROUP BY vox")
def backproject_count(spark, sf_dir):
    return sc.samples_of(g.lors(spark, sf_dir), g.NX, g.NY).groupBy("vox").agg(F.countDistinct("lor_id").alias("n"))
