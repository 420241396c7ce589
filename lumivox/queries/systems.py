"""Queries on system matrices, event selections, and local features of images."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumivox import grid as g
from lumivox.functions import scanner as sc
from lumivox.jobs import reconstruction as r
from lumivox.operators import samples as s
from lumivox.queries import query, shared
from lumivox.queries.reconstruction import GRID, HALVES, MU, NORM, START, mumap, norms, out, rays, start

YX = ("y", "x")
INCLUSIVE = "ray AS (SELECT lor_id, CAST((z1 + floor(n * (z2 - z1) / len)) * 1024 + (y1 + floor(n * (y2 - y1) / len)) * 32 + x1 + floor(n * (x2 - x1) / len) AS INTEGER) AS vox FROM (SELECT *, unnest(range(0, len + 1)) AS n FROM lor))"
LINES = shared("lor") + ", "


@query(LINES + INCLUSIVE + " SELECT vox, count(*) AS n FROM ray GROUP BY vox")
def lines_dda_3d_inclusive(spark, sf_dir):
    """Lines with both their ends."""
    return sc.samples_of(g.lors(spark, sf_dir), g.NX, g.NY, include_end=True).groupBy("vox").agg(F.count("*").alias("n"))


@query(
    LINES + INCLUSIVE + ", " + START + ", " + MU + ", q AS (SELECT lor_id, sum(v) * exp(greatest(-sum(mu), -5)) AS q FROM ray JOIN im0 USING (vox) JOIN mu USING (vox) GROUP BY lor_id), "
    "f AS (SELECT vox, sum(1 / q) AS f FROM ray JOIN q USING (lor_id) GROUP BY vox) SELECT vox, round(v * coalesce(f, 0), 6) + 0.0 AS v FROM im0 LEFT JOIN f USING (vox)"
)
def lmem_attenuated_inclusive(spark, sf_dir):
    """The variant with both ends, full attenuation and its floor at exp(-5)."""
    own = sc.samples_of(g.lors(spark, sf_dir), g.NX, g.NY, include_end=True).withColumn("w", F.lit(1.0))
    seen = own.join(start(spark), "vox", "left").join(mumap(spark), "vox", "left").groupBy("lor_id").agg(F.sum("v").alias("q"), F.sum("mu").alias("a"))
    q = seen.select("lor_id", (F.col("q") * F.exp(F.greatest(-F.col("a"), F.lit(-5.0)))).alias("q"))
    return out(r.update(start(spark), r.back(own, q, 1 / F.col("q"))))


@query(
    shared("lor", "ray") + ", pix AS (SELECT lor_id, vox % 1024 AS vox FROM ray), q AS (SELECT lor_id, count(*) AS q FROM (SELECT DISTINCT lor_id, vox FROM pix) GROUP BY lor_id) "
    "SELECT vox, round(sum(1.0 / q), 6) + 0.0 AS v FROM (SELECT DISTINCT lor_id, vox FROM pix) JOIN q USING (lor_id) GROUP BY vox"
)
def em_distinct_2d(spark, sf_dir):
    """One step on the 32 x 32 image where a line's repeated pixels count once.

    Samples are dealt by line once; pixels and sums of a line, and its value for them, need no more.
    Lines without a number meet none; left out at once, both uses of the samples are the same exchange.
    """
    seen = sc.samples_of(g.lors(spark, sf_dir).where("lor_id IS NOT NULL"), g.NX, g.NY).select("lor_id", (F.col("vox") % 1024).alias("vox"))
    own = seen.repartition("lor_id").distinct().withColumn("w", F.lit(1.0))
    flat = spark.range(1024).select(F.col("id").cast("int").alias("vox"), F.lit(1.0).alias("v"))
    return r.expectation(own, flat).select("vox", g.rounded("f").alias("v"))


@query(
    shared("lor", "ray") + ", im AS (SELECT vox, CASE WHEN vox % 3 = 0 THEN 0.0 ELSE 1.0 END AS v FROM (SELECT CAST(i AS INTEGER) AS vox FROM range(8192) t(i))), q AS (SELECT lor_id, CASE WHEN sum(v) = 0 THEN 1 ELSE sum(v) END AS q FROM ray JOIN im USING (vox) GROUP BY lor_id), "
    "f AS (SELECT vox, sum(1 / q) AS f FROM ray JOIN q USING (lor_id) GROUP BY vox) SELECT vox, round(v * f, 6) + 0.0 AS v FROM im JOIN f USING (vox) WHERE f <> 0"
)
def em_list_dense(spark, sf_dir):
    """List-mode step where a projection of zero counts as one, and only met voxels are updated."""
    own = rays(spark, sf_dir)
    image = start(spark).select("vox", F.when(F.col("vox") % 3 == 0, 0.0).otherwise(1.0).alias("v"))
    q = own.join(image, "vox", "left").groupBy("lor_id").agg(F.sum(F.col("w") * F.col("v")).alias("q")).select("lor_id", F.when(F.col("q") == 0, 1.0).otherwise(F.col("q")).alias("q"))
    return image.join(r.back(own, q, 1 / F.col("q")), "vox").where("f <> 0").select("vox", g.rounded(F.col("v") * F.col("f")).alias("v"))


@query(shared("lor", "ray") + "SELECT lor_id, CAST(row_number() OVER (PARTITION BY lor_id ORDER BY vox) - 1 AS INTEGER) AS slot, vox FROM (SELECT DISTINCT lor_id, vox FROM ray)")
def srm_ell(spark, sf_dir):
    """Rows of the system matrix in slots, in the order of voxels."""
    own = sc.samples_of(g.lors(spark, sf_dir), g.NX, g.NY).distinct()
    return own.select("lor_id", (F.row_number().over(Window.partitionBy("lor_id").orderBy("vox")) - 1).alias("slot"), "vox")


SIDDON = (
    ", c AS (SELECT lor_id, x1, y1, z1, x2, y2, z2, a FROM lor, range(1, 32) t(k), (VALUES (0), (1), (2)) ax(i), LATERAL (SELECT CASE i WHEN 0 THEN (k - x1 - 0.5) / nullif(x2 - x1, 0) WHEN 1 THEN (k - y1 - 0.5) / nullif(y2 - y1, 0) ELSE (k - z1 - 0.5) / nullif(z2 - z1, 0) END AS a) q "
    "WHERE a > 0 AND a < 1 UNION SELECT lor_id, x1, y1, z1, x2, y2, z2, 0.0 FROM lor UNION SELECT lor_id, x1, y1, z1, x2, y2, z2, 1.0 FROM lor), "
    "d AS (SELECT *, lag(a) OVER (PARTITION BY lor_id ORDER BY a) AS b FROM c), seg AS (SELECT lor_id, (a - b) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)) AS w, "
    "CAST(floor(z1 + (a + b) / 2 * (z2 - z1) + 0.5) * 1024 + floor(y1 + (a + b) / 2 * (y2 - y1) + 0.5) * 32 + floor(x1 + (a + b) / 2 * (x2 - x1) + 0.5) AS INTEGER) AS vox FROM d WHERE a - b > 1e-9) "
)


@query(SIDDON + "SELECT vox, round(sum(w), 5) + 0.0 AS v FROM seg GROUP BY vox", "lor")
def siddon_backprojection(spark, sf_dir):
    return r.back_by_lines(g.lors(spark, sf_dir), GRID, weights="lengths").select("vox", g.rounded("f", 5).alias("v"))


@query(SIDDON + ", q AS (SELECT lor_id, sum(w) AS q FROM seg GROUP BY lor_id) SELECT vox, round(sum(w / q), 5) + 0.0 AS v FROM seg JOIN q USING (lor_id) GROUP BY vox", "lor")
def lmem_siddon(spark, sf_dir):
    """One EM step with exact path lengths as weights."""
    image = r.gathered(start(spark), g.NX * g.NY * g.NZ)
    return r.back_by_lines(g.lors(spark, sf_dir), GRID, image, weights="lengths").select("vox", g.rounded("f", 5).alias("v"))


def siddon_step(n: int, image: str, scale: float | None = None, where: str = "true", norm: bool = False) -> str:
    """CTEs of one EM step with exact path lengths from ``image`` to ``im<n>``."""
    fade, mu = (f" * exp(-{scale} * sum(w * mu))", " JOIN mu USING (vox)") if scale else ("", "")
    factor, nm = ("coalesce(f, 0) / norm", " JOIN nm USING (vox)") if norm else ("coalesce(f, 0)", "")
    return (
        f", part{n} AS (SELECT * FROM seg WHERE {where}), q{n} AS (SELECT lor_id, sum(w * v){fade} AS q FROM part{n} JOIN {image} USING (vox){mu} GROUP BY lor_id), "
        f"f{n} AS (SELECT vox, sum(w / q) AS f FROM part{n} JOIN q{n} USING (lor_id) WHERE q <> 0 GROUP BY vox), im{n} AS (SELECT vox, v * {factor} AS v FROM {image} LEFT JOIN f{n} USING (vox){nm})"
    )


EXACT = f"{SIDDON}, {START}, {MU}, {NORM}"


def exact(image):
    return image.select("vox", g.rounded("v", 5).alias("v"))


@query(EXACT + siddon_step(1, "im0", 0.5) + " SELECT vox, round(v, 5) + 0.0 AS v FROM im1", "lor")
def lmem_siddon_attenuated(spark, sf_dir):
    """One EM step with exact path lengths, attenuated by half of their sum over the map."""
    return exact(r.em_step(g.lors(spark, sf_dir), start(spark), GRID, mumap(spark), 0.5, weights="lengths"))


def in_halves(spark, sf_dir, **step):
    """Two subsets of lines by their number, the image updated and normalised after each."""
    return r.ordered_subsets(g.lors(spark, sf_dir), start(spark), F.col("lor_id") % 2, 2, GRID, weights="lengths", norm=norms(spark), **step)


HALVED = "{0}{1} SELECT vox, round(v, 5) + 0.0 AS v FROM im2"


@query(EXACT + HALVED.format(siddon_step(1, "im0", None, HALVES[0], True), siddon_step(2, "im1", None, HALVES[1], True)), "lor")
def oplem_siddon(spark, sf_dir):
    """One pass over two subsets with exact path lengths."""
    return exact(in_halves(spark, sf_dir))


@query(EXACT + HALVED.format(siddon_step(1, "im0", 0.3333, HALVES[0], True), siddon_step(2, "im1", 0.3333, HALVES[1], True)), "lor")
def oplem_siddon_attenuated(spark, sf_dir):
    return exact(in_halves(spark, sf_dir, mu=mumap(spark), scale=0.3333))


@query("SELECT lor_id, c1, d1, c2, d2 FROM event WHERE d1 = 7 OR d2 = 7", "event")
def pack_id(spark, sf_dir):
    """Events of one module."""
    return g.detector_events(spark, sf_dir).where("d1 = 7 OR d2 = 7")


@query("SELECT lor_id FROM lor WHERE (x1 + x2) / 2 BETWEEN 8 AND 24 AND (y1 + y2) / 2 BETWEEN 8 AND 24", "lor")
def lor_center(spark, sf_dir):
    """Lines whose middle lies in the region of interest."""
    return g.lors(spark, sf_dir).where("(x1 + x2) / 2 BETWEEN 8 AND 24 AND (y1 + y2) / 2 BETWEEN 8 AND 24").select("lor_id")


UNIFORM = "((event_id * 1103515245 + 12345) % 2147483648 + 1) / 2147483649.0"


@query(f"SELECT event_id, round(-ln({UNIFORM}::DOUBLE) / 0.018, 6) + 0.0 AS path FROM events")
def free_path(spark, sf_dir):
    """Exponential free paths from each event's own uniform number."""
    u = F.expr("((event_id * 1103515245L + 12345L) % 2147483648L + 1) / 2147483649.0D")
    return g.table(spark, sf_dir, "events").select("event_id", g.rounded(-F.log(u) / 0.018).alias("path"))


@query(
    "SELECT event_id, CAST(floor(round(r1 * 64 / (2 * pi()), 7)) % 64 AS INTEGER) AS id1, CAST(floor(round(r2 * 64 / (2 * pi()), 7)) % 64 AS INTEGER) AS id2 FROM (SELECT event_id, "
    "(atan2(py + t1 * sa, px + t1 * ca) + 2 * pi()) AS r1, (atan2(py + t2 * sa, px + t2 * ca) + 2 * pi()) AS r2 FROM (SELECT *, -b + sqrt(b * b - c) AS t1, -b - sqrt(b * b - c) AS t2 FROM "
    "(SELECT *, px * ca + py * sa AS b, px * px + py * py - 100 AS c FROM (SELECT event_id, event_id % 9 - 4 AS px, user_id % 7 - 3 AS py, cos((event_id * 37 % 360 + 0.5) * pi() / 180) AS ca, sin((event_id * 37 % 360 + 0.5) * pi() / 180) AS sa FROM events))))"
)
def ring_simulation(spark, sf_dir):
    """Crystals of a ring of radius 10 that two opposite photons from a point reach."""
    angle = F.radians(F.col("event_id") * 37 % 360 + 0.5)
    p = g.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9 - 4).alias("px"), (F.col("user_id") % 7 - 3).alias("py"), F.cos(angle).alias("ca"), F.sin(angle).alias("sa"))
    p = p.withColumn("b", F.col("px") * F.col("ca") + F.col("py") * F.col("sa")).withColumn("root", F.sqrt(F.col("b") * F.col("b") - (F.col("px") ** 2 + F.col("py") ** 2 - 100)))
    full = 2 * 3.141592653589793

    def crystal(t):
        theta = F.atan2(F.col("py") + t * F.col("sa"), F.col("px") + t * F.col("ca")) + full
        return (F.floor(F.round(theta * 64 / full, 7)) % 64).cast("int")

    return p.select("event_id", crystal(-F.col("b") + F.col("root")).alias("id1"), crystal(-F.col("b") - F.col("root")).alias("id2"))


NEAR = "FROM pixel a JOIN pixel b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"


@query(
    f", loc AS (SELECT a.image_id, a.y, a.x, any_value(a.v) AS v, avg(b.v) AS m, var_pop(b.v) AS s {NEAR} WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY a.image_id, a.y, a.x), "
    "noise AS (SELECT image_id, avg(s) AS n FROM loc GROUP BY image_id) SELECT image_id, y, x, round(CASE WHEN s < n THEN m ELSE m + (s - n) / s * (v - m) END, 6) + 0.0 AS v FROM loc JOIN noise USING (image_id)",
    "pixel",
)
def wiener(spark, sf_dir):
    """Adaptive smoothing: local means and variances of 3 x 3 windows against the image's mean variance."""
    p = g.pixels(spark, sf_dir)
    window = s.neighbourhood(p, YX, 1).where("y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6").groupBy("image_id", "y", "x")
    local = window.agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).join(p, ["image_id", "y", "x"])
    noise = local.groupBy("image_id").agg(F.avg("s").alias("n"))
    smooth = F.when(F.col("s") < F.col("n"), F.col("m")).otherwise(F.col("m") + (F.col("s") - F.col("n")) / F.col("s") * (F.col("v") - F.col("m")))
    return local.join(noise, "image_id").select("image_id", "y", "x", g.rounded(smooth).alias("v"))


@query(
    ", gr AS (SELECT a.image_id, a.y, a.x, sum(CASE WHEN b.y = a.y THEN (b.x - a.x) * b.v ELSE 0 END) AS gx, sum(CASE WHEN b.x = a.x THEN (b.y - a.y) * b.v ELSE 0 END) AS gy "
    f"{NEAR} GROUP BY a.image_id, a.y, a.x), t AS (SELECT a.image_id, a.y, a.x, sum(b.gx * b.gx) AS xx, sum(b.gy * b.gy) AS yy, sum(b.gx * b.gy) AS xy FROM gr a JOIN gr b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x) "
    "SELECT image_id, y, x, round(xx * yy - xy * xy - 0.04 * (xx + yy) * (xx + yy), 6) + 0.0 AS v FROM t",
    "pixel",
)
def harris(spark, sf_dir):
    """Corner response from summed products of central differences."""
    p = g.pixels(spark, sf_dir)
    along = lambda d, other: F.sum(F.when(F.col(other) == 0, -F.col(d) * F.col("v")).otherwise(0.0))
    inside = "y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7"
    slopes = s.neighbourhood(p, YX, 1).where(inside).groupBy("image_id", "y", "x").agg(along("dx", "dy").alias("gx"), along("dy", "dx").alias("gy"))
    spread = s.neighbourhood(slopes, YX, 1).where(inside).groupBy("image_id", "y", "x")
    t = spread.agg(F.sum(F.col("gx") * F.col("gx")).alias("xx"), F.sum(F.col("gy") * F.col("gy")).alias("yy"), F.sum(F.col("gx") * F.col("gy")).alias("xy"))
    trace = F.col("xx") + F.col("yy")
    return t.select("image_id", "y", "x", g.rounded(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") - 0.04 * trace * trace).alias("v"))


@query(
    ", strong AS (SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS n FROM pixel), patch AS (SELECT s.image_id, s.n, p.y - s.y AS dy, p.x - s.x AS dx, p.v FROM strong s JOIN pixel p ON s.image_id = p.image_id AND abs(p.y - s.y) <= 1 AND abs(p.x - s.x) <= 1 WHERE s.n <= 4), "
    "d AS (SELECT a.image_id, a.n AS p1, b.n AS p2, sum((a.v - b.v) * (a.v - b.v)) / count(*) AS ssd FROM patch a JOIN patch b ON b.image_id = a.image_id + 1 AND a.dy = b.dy AND a.dx = b.dx GROUP BY ALL) "
    "SELECT image_id, CAST(p1 AS INTEGER) AS p1, CAST(p2 AS INTEGER) AS p2, round(ssd, 6) + 0.0 AS ssd FROM (SELECT *, row_number() OVER (PARTITION BY image_id, p1 ORDER BY ssd, p2) AS r FROM d) WHERE r = 1",
    "pixel",
)
def match_points(spark, sf_dir):
    """For the four strongest points of each image the most alike of the next image's, by their patches."""
    p = g.pixels(spark, sf_dir)
    order = Window.partitionBy("image_id").orderBy(F.desc("v"), "y", "x")
    strong = p.withColumn("n", F.row_number().over(order)).where("n <= 4").select("image_id", "n", F.col("y").alias("cy"), F.col("x").alias("cx"))
    around = strong.withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dx", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    around = around.withColumn("y", F.col("cy") + F.col("dy")).withColumn("x", F.col("cx") + F.col("dx"))
    patch = around.join(p, ["image_id", "y", "x"]).select("image_id", "n", "dy", "dx", "v")
    other = patch.select((F.col("image_id") - 1).alias("image_id"), F.col("n").alias("p2"), "dy", "dx", F.col("v").alias("w"))
    each = patch.join(other, ["image_id", "dy", "dx"]).groupBy("image_id", F.col("n").alias("p1"), "p2").agg((F.sum(F.pow(F.col("v") - F.col("w"), 2)) / F.count("*")).alias("ssd"))
    best = each.groupBy("image_id", "p1").agg(F.min(F.struct("ssd", "p2")).alias("b"))
    return best.select("image_id", "p1", "b.p2", g.rounded("b.ssd").alias("ssd"))


@query(
    "SELECT image_id, CAST(c AS INTEGER) AS c, round(min(v * c), 6) + 0.0 AS least, round(max(v * c), 6) + 0.0 AS most, round(avg(v * c), 6) + 0.0 AS mean, round(var_pop(v * c), 6) + 0.0 AS var FROM pixel, range(1, 4) t(c) GROUP BY ALL", "pixel"
)
def channel_info(spark, sf_dir):
    """Figures of each channel of images that were given three."""
    rgb = g.pixels(spark, sf_dir).withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("v", F.col("v") * F.col("c"))
    figures = {"least": F.min, "most": F.max, "mean": F.avg, "var": F.var_pop}
    return rgb.groupBy("image_id", "c").agg(*(g.rounded(f("v")).alias(n) for n, f in figures.items()))


@query(
    "SELECT image_id, y, x, CASE WHEN n = 2 THEN round((v1 + v2) / 2, 6) + 0.0 ELSE round(coalesce(v1, v2), 6) + 0.0 END AS v FROM (SELECT image_id, y, x, sum(v) FILTER (k = 1) AS v1, sum(v) FILTER (k = 2) AS v2, count(*) AS n FROM "
    "(SELECT image_id, y, x, v, 1 AS k FROM pixel UNION ALL SELECT image_id - 1, CAST(y + 2 AS INTEGER), CAST(x + 3 AS INTEGER), v, 2 FROM pixel) GROUP BY ALL)",
    "pixel",
)
def space_merge(spark, sf_dir):
    """Each image and the next one, tied together at a shift; where they overlap their mean."""
    p = g.pixels(spark, sf_dir)
    other = s.moved(p, y="y + 2", x="x + 3").withColumn("image_id", F.col("image_id") - 1)
    return p.unionByName(other).groupBy("image_id", "y", "x").agg(g.rounded(F.avg("v")).alias("v"))


@query("SELECT image_id, CAST(y2 AS INTEGER) AS y, CAST(x2 AS INTEGER) AS x, v FROM (SELECT CAST(i // 8 AS INTEGER) AS y2, CAST(i % 8 AS INTEGER) AS x2 FROM range(64) t(i)) JOIN pixel ON y = (3 * y2 + x2) // 4 AND x = (3 * x2 + y2) // 4", "pixel")
def warp_nearest(spark, sf_dir):
    """Backward warp by an integer linear map, nearest sample below."""
    target = g.grid(spark, y2=8, x2=8).select("y2", "x2", F.expr("CAST((3 * y2 + x2) DIV 4 AS INT)").alias("y"), F.expr("CAST((3 * x2 + y2) DIV 4 AS INT)").alias("x"))
    return g.pixels(spark, sf_dir).join(F.broadcast(target), ["y", "x"]).select("image_id", F.col("y2").alias("y"), F.col("x2").alias("x"), "v")


def bresenham(axes: str):
    """Rows (lor_id, place per axis) of integer lines: steps of the longest axis, the others to the nearest cell."""
    cells = ", ".join(f"CAST({a}1 + sign({a}2 - {a}1) * floor((2 * n * abs({a}2 - {a}1) + far) / (2 * far)) AS INTEGER) AS {a}" for a in axes)
    far = "greatest(" + ", ".join(f"abs({a}2 - {a}1)" for a in axes) + ")"

    @query(f", s AS (SELECT *, {far} AS far, unnest(range(0, {far} + 1)) AS n FROM lor WHERE {far} > 0) SELECT {', '.join(axes)}, count(*) AS n FROM (SELECT {cells} FROM s) GROUP BY ALL", "lor", name=f"lines_bresenham_{len(axes)}d")
    def run(spark, sf_dir):
        lines = g.lors(spark, sf_dir).withColumn("far", F.expr(far)).where("far > 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("far"))))
        place = lambda a: F.expr(f"CAST({a}1 + sign({a}2 - {a}1) * ((2 * n * abs({a}2 - {a}1) + far) DIV (2 * far)) AS INT)").alias(a)
        return lines.select(*map(place, axes)).groupBy(*axes).agg(F.count("*").alias("n"))


bresenham("yx")
bresenham("zyx")

#: A uniform number of each pixel, from its place alone.
SEED = "((image_id * 64 + y * 8 + x) * 1103515245 + 12345) % 2147483648"


def noisy(name: str, sql: str, change):
    @query(f"SELECT image_id, y, x, round(v + {sql}, 6) + 0.0 AS v FROM (SELECT *, ({SEED} + 1) / 2147483649.0::DOUBLE AS u, (({SEED}) * 48271 % 2147483647) / 2147483647.0::DOUBLE AS w FROM pixel)", "pixel", name=name)
    def run(spark, sf_dir):
        seed = SEED.replace("1103515245", "1103515245L").replace("12345)", "12345L)")
        p = g.pixels(spark, sf_dir).withColumn("u", F.expr(f"({seed} + 1) / 2147483649.0D")).withColumn("w", F.expr(f"(({seed}) * 48271L % 2147483647L) / 2147483647.0D"))
        return p.select("image_id", "y", "x", g.rounded(F.col("v") + change(F.col("u"), F.col("w"))).alias("v"))


noisy("image_noise_gauss", "0.1 * sqrt(-2 * ln(u)) * cos(2 * pi() * w)", lambda u, w: 0.1 * F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * w))
noisy("image_noise_exponential", "-0.1 * ln(u)", lambda u, w: -0.1 * F.log(u))


@query(
    ", h AS (SELECT image_id, y, x, v, CAST(greatest(0, least(9, floor(round((v - lo) / (hi - lo) * 10, 9)))) AS INTEGER) AS bin FROM (SELECT *, min(v) OVER p AS lo, max(v) OVER p AS hi FROM pixel WINDOW p AS (PARTITION BY image_id))) SELECT image_id, bin, count(*) AS n, round(avg(v), 6) + 0.0 AS mean FROM h GROUP BY ALL",
    "pixel",
)
def image_hist(spark, sf_dir):
    """Ten equal bins between each image's least and largest value, the last closed upward."""
    scaled = s.min_max(g.pixels(spark, sf_dir), "image_id").withColumn("bin", F.least(F.lit(9), F.floor(F.round(F.col("v") * 10, 9))).cast("int"))
    both = scaled.select("image_id", "y", "x", "bin").join(g.pixels(spark, sf_dir), ["image_id", "y", "x"])
    return both.groupBy("image_id", "bin").agg(F.count("*").alias("n"), g.rounded(F.avg("v")).alias("mean"))


@query(
    ", s AS (SELECT lor_id, n, CAST((z1 + floor(n * (z2 - z1) / len)) * 1024 + (y1 + floor(n * (y2 - y1) / len)) * 32 + x1 + floor(n * (x2 - x1) / len) AS INTEGER) AS vox FROM (SELECT *, unnest(range(0, len)) AS n FROM lor)) "
    "SELECT lor_id, arg_min(vox, n) AS vox, CAST(min(n) AS INTEGER) AS step, count(*) AS n FROM s WHERE vox % 3 = 0 GROUP BY lor_id",
    "lor",
)
def first_hit(spark, sf_dir):
    """For every line the first marked voxel along it, after how many steps, and the number of marked ones it meets."""
    met = sc.samples_of(g.lors(spark, sf_dir), g.NX, g.NY, step=True).where("vox % 3 = 0")
    return met.groupBy("lor_id").agg(F.min_by("vox", "n").alias("vox"), F.min("n").alias("step"), F.count("*").alias("n"))
