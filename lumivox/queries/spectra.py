"""Queries in the frequency domain; the SQL beside them is the defining double sum."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumivox import grid as g
from lumivox.functions import transfer as t
from lumivox.operators import samples as s
from lumivox.operators import spectral as f
from lumivox.queries import query

YX, ZYX = ("y", "x"), ("z", "y", "x")
DFT = (
    ", spec AS (SELECT image_id, CAST(ky AS INTEGER) AS ky, CAST(kx AS INTEGER) AS kx, sum(v * cos(2 * pi() * ((ky - 4) * y + (kx - 4) * x) / 8)) AS re, "
    "-sum(v * sin(2 * pi() * ((ky - 4) * y + (kx - 4) * x) / 8)) AS im FROM pixel, range(8) a(ky), range(8) b(kx) GROUP BY ALL) "
)
RADIUS = "sqrt((ky - 4) * (ky - 4) + (kx - 4) * (kx - 4))"


def spectrum(spark, sf_dir):
    return f.transformed(g.pixels(spark, sf_dir), "image_id", YX, 8)


@query(DFT + "SELECT image_id, ky, kx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM spec", "pixel")
def image_fft(spark, sf_dir):
    return spectrum(spark, sf_dir).withColumns({"re": g.rounded("re"), "im": g.rounded("im")})


@query("SELECT image_id, y, x, round(abs(v), 6) + 0.0 AS v FROM pixel", "pixel")
def image_ifft(spark, sf_dir):
    """Forth and back: the moduli of the image."""
    return f.transformed(spectrum(spark, sf_dir), "image_id", YX, 8, inverse=True).withColumn("v", g.rounded("v"))


@query(DFT + "SELECT image_id, ky, kx, round((re * re + im * im) / 64, 6) + 0.0 AS v FROM spec", "pixel")
def image_pows(spark, sf_dir):
    return f.power(spectrum(spark, sf_dir), 64).withColumn("v", g.rounded("v"))


RINGS = (
    ", r AS (SELECT image_id, {v} AS v, {r} AS r FROM {source}), q AS (SELECT image_id, v, r, CAST(floor(r) AS INTEGER) AS low FROM r WHERE floor(r) <= 4), "
    "p AS (SELECT image_id, v, low AS bin, 1 - (r - low) AS w FROM q UNION ALL SELECT image_id, v, low + 1, r - low FROM q) "
    "SELECT image_id, bin, round(sum(w * v) / sum(w), 6) + 0.0 AS val, bin / 8.0::DOUBLE AS freq FROM p WHERE bin <= 4 AND w > 0 GROUP BY image_id, bin"
)


@query(RINGS.format(v="v", r="sqrt((y - 4) * (y - 4) + (x - 4) * (x - 4))", source="pixel"), "pixel")
def image_ra(spark, sf_dir):
    return s.radial_average(g.pixels(spark, sf_dir), "image_id", YX, 8).withColumn("val", g.rounded("val"))


@query(DFT + RINGS.format(v="(re * re + im * im) / 64", r=RADIUS, source="spec"), "pixel")
def image_raps(spark, sf_dir):
    return s.radial_average(f.power(spectrum(spark, sf_dir), 64), "image_id", ("ky", "kx"), 8).withColumn("val", g.rounded("val"))


@query(
    DFT + ", two AS (SELECT a.image_id, a.re * b.re + a.im * b.im AS c, a.re * a.re + a.im * a.im AS p1, b.re * b.re + b.im * b.im AS p2, sqrt((a.ky - 4) * (a.ky - 4) + (a.kx - 4) * (a.kx - 4)) AS r "
    "FROM spec a JOIN spec b ON b.image_id = a.image_id + 1 AND a.ky = b.ky AND a.kx = b.kx), q AS (SELECT *, CAST(floor(r) AS INTEGER) AS low FROM two WHERE floor(r) <= 4), "
    "e AS (SELECT image_id, c, p1, p2, low AS bin, 1 - (r - low) AS w FROM q UNION ALL SELECT image_id, c, p1, p2, low + 1, r - low FROM q) "
    "SELECT image_id, bin, round(sum(w * c) / sqrt(sum(w * p1) * sum(w * p2)), 6) + 0.0 AS val FROM e WHERE bin <= 4 AND w > 0 GROUP BY image_id, bin",
    "pixel",
)
def image_frc(spark, sf_dir):
    first = spectrum(spark, sf_dir)
    second = first.withColumn("image_id", F.col("image_id") - 1)
    return f.ring_correlation(first, second, "image_id", YX, 8).withColumn("val", g.rounded("val"))


SHELLS = (
    ", r AS (SELECT volume_id, v, sqrt((z - 4) * (z - 4) + (y - 4) * (y - 4) + (x - 4) * (x - 4)) AS r FROM voxel), q AS (SELECT volume_id, v, r, CAST(floor(r) AS INTEGER) AS low FROM r WHERE floor(r) <= 4), "
    "p AS (SELECT volume_id, v, low AS bin, 1 - (r - low) AS w FROM q UNION ALL SELECT volume_id, v, low + 1, r - low FROM q) "
    "SELECT volume_id, bin, round(sum(w * v) / sum(w), 6) + 0.0 AS val, bin / 8.0::DOUBLE AS freq FROM p WHERE bin <= 4 AND w > 0 GROUP BY volume_id, bin"
)


@query(SHELLS, "voxel")
def volume_ra(spark, sf_dir):
    return s.radial_average(g.voxels(spark, sf_dir), "volume_id", ZYX, 8).withColumn("val", g.rounded("val"))


VDFT = (
    ", spec AS (SELECT volume_id, CAST(kz AS INTEGER) AS kz, CAST(ky AS INTEGER) AS ky, CAST(kx AS INTEGER) AS kx, sum(v * cos(2 * pi() * ((kz - 4) * z + (ky - 4) * y + (kx - 4) * x) / 8)) AS re, "
    "-sum(v * sin(2 * pi() * ((kz - 4) * z + (ky - 4) * y + (kx - 4) * x) / 8)) AS im FROM voxel, range(8) c(kz), range(8) a(ky), range(8) b(kx) GROUP BY ALL) "
)


def cube(spark, sf_dir):
    return f.transformed(g.voxels(spark, sf_dir), "volume_id", ZYX, 8)


@query(VDFT + "SELECT CAST(volume_id AS BIGINT) AS volume_id, kz, ky, kx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM spec", "voxel")
def volume_fft(spark, sf_dir):
    return cube(spark, sf_dir).withColumns({"re": g.rounded("re"), "im": g.rounded("im")})


@query(VDFT + "SELECT CAST(volume_id AS BIGINT) AS volume_id, kz, ky, kx, round((re * re + im * im) / 512, 6) + 0.0 AS v FROM spec", "voxel")
def volume_pows(spark, sf_dir):
    return f.power(cube(spark, sf_dir), 512).withColumn("v", g.rounded("v"))


@query(
    VDFT + ", two AS (SELECT a.volume_id, a.re * b.re + a.im * b.im AS c, a.re * a.re + a.im * a.im AS p1, b.re * b.re + b.im * b.im AS p2, sqrt((a.kz - 4) * (a.kz - 4) + (a.ky - 4) * (a.ky - 4) + (a.kx - 4) * (a.kx - 4)) AS r "
    "FROM spec a JOIN spec b ON b.volume_id = a.volume_id + 1 AND a.kz = b.kz AND a.ky = b.ky AND a.kx = b.kx), q AS (SELECT *, CAST(floor(r) AS INTEGER) AS low FROM two WHERE floor(r) <= 4), "
    "e AS (SELECT volume_id, c, p1, p2, low AS bin, 1 - (r - low) AS w FROM q UNION ALL SELECT volume_id, c, p1, p2, low + 1, r - low FROM q) "
    "SELECT CAST(volume_id AS BIGINT) AS volume_id, bin, round(sum(w * c) / sqrt(sum(w * p1) * sum(w * p2)), 6) + 0.0 AS val FROM e WHERE bin <= 4 AND w > 0 GROUP BY volume_id, bin",
    "voxel",
)
def volume_fsc(spark, sf_dir):
    first = cube(spark, sf_dir)
    return f.ring_correlation(first, first.withColumn("volume_id", F.col("volume_id") - 1), "volume_id", ZYX, 8).withColumn("val", g.rounded("val"))


#: Transfer functions: an expression, and the same in SQL of the frequency f.
SINC = "CASE WHEN {x} = 0 THEN 1.0 ELSE sin(pi() * ({x})) / (pi() * ({x})) END"
TRANSFERS = {
    "gaussian": (lambda x: t.gaussian(x, 0.2), "exp(-(f * f) / (2 * 0.2 * 0.2))"),
    "metz": (lambda x: t.metz(x, 3, 0.2), "(1 - (1 - exp(-(f * f) / 0.08) * exp(-(f * f) / 0.08)) ** 4) / exp(-(f * f) / 0.08)"),
    "butterworth_lp": (lambda x: t.butterworth_lp(x, 2, 0.25), "1 / sqrt(1 + (f / 0.25) ** 4)"),
    "butterworth_hp": (lambda x: t.butterworth_hp(x, 2, 0.25), "1 / sqrt(1 + ((0.5 - f) / 0.25) ** 4)"),
    "butterworth_bp": (lambda x: t.butterworth_bp(x, 2, 0.1, 0.3), "1 / sqrt(1 + (f / 0.3) ** 4) / sqrt(1 + ((0.5 - f) / 0.4) ** 4)"),
    "tanh_lp": (lambda x: t.tanh_lp(x, 0.5, 0.25), "0.5 - 0.5 * tanh(pi() * (f - 0.25) / (2 * 0.5 * 0.25))"),
    "tanh_hp": (lambda x: t.tanh_hp(x, 0.5, 0.25), "0.5 + 0.5 * tanh(pi() * (f - 0.25) / (2 * 0.5 * 0.25))"),
    "lanczos2": (lambda x: t.lanczos(x, 2), SINC.format(x="f * 4") + " * " + SINC.format(x="f * 2")),
    "lanczos3": (lambda x: t.lanczos(x, 3), SINC.format(x="f * 6") + " * " + SINC.format(x="f * 2")),
}


def filter_queries(name: str, transfer, sql: str):
    back = (
        DFT + f", h AS (SELECT image_id, ky, kx, re * h AS re, im * h AS im FROM (SELECT *, {sql} AS h FROM (SELECT *, {RADIUS} / 8 AS f FROM spec))) "
        "SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sqrt(pow(sum(re * cos(a) - im * sin(a)) / 64, 2) + pow(sum(re * sin(a) + im * cos(a)) / 64, 2)), 6) + 0.0 AS v "
        "FROM (SELECT h.*, y, x, 2 * pi() * ((ky - 4) * y + (kx - 4) * x) / 8 AS a FROM h, range(8) q(y), range(8) p(x)) GROUP BY image_id, y, x"
    )

    @query(back, "pixel", name=f"filter_2d_{name}")
    def apply(spark, sf_dir):
        return f.filtered(g.pixels(spark, sf_dir), "image_id", YX, 8, transfer).withColumn("v", g.rounded("v"))

    for axes in (1, 2, 3):
        k = ("kz", "ky", "kx")[3 - axes :]
        source = "pixel" if axes < 3 else "voxel"
        key = "image_id" if axes < 3 else "volume_id"
        used = {"kx": "x", "ky": "y", "kz": "z"}
        radius = "sqrt(" + " + ".join(f"({used[a]} - 4) * ({used[a]} - 4)" for a in k) + ") / 8"

        every = "z, y, x" if axes == 3 else "y, x"

        # H at each place of the grid, beside the samples and what is left of them.
        @query(f"SELECT {key}, {every}, round({sql}, 6) + 0.0 AS h, round(v * ({sql}), 6) + 0.0 AS v FROM (SELECT *, {radius} AS f FROM {source})", source, name=f"filter_build_{axes}d_{name}")
        def build(spark, sf_dir, k=k, used=used, source=source, key=key, every=every):
            samples = g.pixels(spark, sf_dir) if source == "pixel" else g.voxels(spark, sf_dir)
            table = g.grid(spark, **{used[a]: 8 for a in k})
            table = table.withColumn("h", transfer(s.distance([used[a] for a in k], [4] * len(k)) / 8))
            weighed = samples.join(F.broadcast(table), [used[a] for a in k])
            return weighed.select(key, *every.split(", "), g.rounded("h").alias("h"), g.rounded(F.col("v") * F.col("h")).alias("v"))


for _name, (_transfer, _sql) in TRANSFERS.items():
    filter_queries(_name, _transfer, _sql)


@query(DFT + "SELECT image_id, CAST(kx - 4 AS INTEGER) AS i, (kx - 4) / 8.0::DOUBLE AS freq, round((re * re + im * im) / 64, 6) + 0.0 AS v FROM spec WHERE ky = 4 AND kx >= 4", "pixel")
def filter_profil(spark, sf_dir):
    """Profile of a spectrum from its centre along x."""
    line = f.power(spectrum(spark, sf_dir), 64).where("ky = 4 AND kx >= 4")
    return line.select("image_id", (F.col("kx") - 4).alias("i"), ((F.col("kx") - 4) / 8).alias("freq"), g.rounded("v").alias("v"))


@query(VDFT + SHELLS.replace("FROM voxel", "FROM spec").replace("(z - 4) * (z - 4) + (y - 4) * (y - 4) + (x - 4) * (x - 4)", "(kz - 4) * (kz - 4) + (ky - 4) * (ky - 4) + (kx - 4) * (kx - 4)").replace("SELECT volume_id, v, sqrt", "SELECT CAST(volume_id AS BIGINT) AS volume_id, (re * re + im * im) / 512 AS v, sqrt", 1), "voxel")
def volume_raps(spark, sf_dir):
    return s.radial_average(f.power(cube(spark, sf_dir), 512), "volume_id", ("kz", "ky", "kx"), 8).withColumn("val", g.rounded("val"))


def volume_filter(name: str, transfer, sql: str):
    radius = "sqrt((kz - 4) * (kz - 4) + (ky - 4) * (ky - 4) + (kx - 4) * (kx - 4))"
    back = (
        VDFT + f", h AS (SELECT volume_id, kz, ky, kx, re * h AS re, im * h AS im FROM (SELECT *, {sql} AS h FROM (SELECT *, {radius} / 8 AS f FROM spec))) "
        "SELECT CAST(volume_id AS BIGINT) AS volume_id, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sqrt(pow(sum(re * cos(a) - im * sin(a)) / 512, 2) + pow(sum(re * sin(a) + im * cos(a)) / 512, 2)), 6) + 0.0 AS v "
        "FROM (SELECT h.*, z, y, x, 2 * pi() * ((kz - 4) * z + (ky - 4) * y + (kx - 4) * x) / 8 AS a FROM h, range(8) o(z), range(8) q(y), range(8) p(x)) GROUP BY volume_id, z, y, x"
    )

    @query(back, "voxel", name=f"filter_3d_{name}")
    def apply(spark, sf_dir):
        return f.filtered(g.voxels(spark, sf_dir), "volume_id", ZYX, 8, transfer).withColumn("v", g.rounded("v"))


for _name in ("gaussian", "metz", "butterworth_lp", "tanh_lp"):
    volume_filter(_name, *TRANSFERS[_name])
