"""Queries on curves, points, distributions and text forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumivox import grid as g
from lumivox.lineage import cut
from lumivox.operators import pyramid
from lumivox.queries import query

DAYS = "WITH days AS (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(value) AS v, count(*) AS n FROM events GROUP BY ALL) "


def days(spark, sf_dir):
    events = g.table(spark, sf_dir, "events")
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))


@query(DAYS + "SELECT day, round(v, 6) + 0.0 AS v, n FROM days")
def frame_cut(spark, sf_dir):
    """Events cut into frames of a day."""
    return days(spark, sf_dir).select("day", g.rounded("v").alias("v"), "n")


@query(
    DAYS + ", once AS (SELECT day, (v + coalesce(lead(v) OVER w, v)) / 2 AS v FROM days WINDOW w AS (ORDER BY day)), twice AS (SELECT day, (v + coalesce(lead(v) OVER w, v)) / 2 AS v FROM once WINDOW w AS (ORDER BY day)) SELECT day, round(v, 6) + 0.0 AS v FROM twice"
)
def curve_smooth(spark, sf_dir):
    """Two passes over the daily curve, each point the mean of itself and the next, the last kept; days are few, events are not ordered."""
    w, curve = Window.orderBy("day"), days(spark, sf_dir).select("day", "v")
    for _ in range(2):
        curve = curve.select("day", ((F.col("v") + F.coalesce(F.lead("v").over(w), "v")) / 2).alias("v"))
    return curve.select("day", g.rounded("v").alias("v"))


@query(
    "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(19, floor(round((value - lo) / (hi - lo) * 20, 9))) AS INTEGER) AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY ALL"
)
def vector_hist(spark, sf_dir):
    """Histogram of 20 equal bins, the last closed upward."""
    events = g.table(spark, sf_dir, "events").select("value").where("value IS NOT NULL")
    ends = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row
    place = F.floor(F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20, 9))
    return events.join(F.broadcast(ends)).groupBy(F.least(F.lit(19), place).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "WITH p AS (SELECT event_id, event_type AS grp, value / 100 AS x, CAST(user_id % 8 AS DOUBLE) AS y FROM events), c AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY grp)), "
    "s AS (SELECT grp, sqrt(2.0::DOUBLE) / nullif(avg(sqrt(dx * dx + dy * dy)), 0) AS scale FROM c GROUP BY grp) SELECT event_id, round(scale * dx, 6) + 0.0 AS x, round(scale * dy, 6) + 0.0 AS y FROM c JOIN s USING (grp)"
)
def norm2d_pts(spark, sf_dir):
    """The points of each type of event about their centre, scaled to a mean distance of the square root of two.

    Centres and scales are grouped sums, joined back to the points; types are few.
    """
    p = points(spark, sf_dir).join(g.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("grp")), "event_id")
    centres = p.groupBy("grp").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    moved = p.join(centres, "grp").select("event_id", "grp", (F.col("x") - F.col("cx")).alias("dx"), (F.col("y") - F.col("cy")).alias("dy"))
    scales = moved.groupBy("grp").agg(F.try_divide(F.sqrt(F.lit(2.0)), F.avg(F.hypot("dx", "dy"))).alias("scale"))
    return moved.join(scales, "grp").select("event_id", *(g.rounded(F.col("scale") * F.col(f"d{a}")).alias(a) for a in "xy"))


PTS = "SELECT event_id, value / 100 AS x, CAST(user_id % 8 AS DOUBLE) AS y FROM events"


def points(spark, sf_dir):
    return g.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("x"), (F.col("user_id") % 8).cast("double").alias("y"))


def beside_next(spark, sf_dir):
    p = points(spark, sf_dir)
    following = p.select((F.col("event_id") - 1).alias("event_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return p.join(following, "event_id")


@query(f"WITH p AS ({PTS}) SELECT a.event_id, round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 6) + 0.0 AS d FROM p a JOIN p b ON b.event_id = a.event_id + 1")
def dist_pts(spark, sf_dir):
    return beside_next(spark, sf_dir).select("event_id", g.rounded(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("d"))


@query(f"WITH p AS ({PTS}) SELECT a.event_id, round(degrees(atan2(b.y - a.y, b.x - a.x)), 6) + 0.0 AS angle FROM p a JOIN p b ON b.event_id = a.event_id + 1")
def ori_pts(spark, sf_dir):
    return beside_next(spark, sf_dir).select("event_id", g.rounded(F.degrees(F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")))).alias("angle"))


CDF = "WITH cdf AS (SELECT p_partkey AS idx, sum(CAST(round(p_retailprice * 100) AS BIGINT)) OVER (ORDER BY p_partkey) AS upto, sum(CAST(round(p_retailprice * 100) AS BIGINT)) OVER () AS total FROM part) "


def cumulative(spark, sf_dir):
    """(idx, before, upto, total): running sums of integer weights, in blocks so that no long run meets in one task."""
    w = g.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.round(F.col("p_retailprice") * 100).cast("long").alias("w"))
    w = w.withColumn("block", F.floor(F.col("idx") / 1000))
    sums = w.groupBy("block").agg(F.sum("w").alias("own"))
    by_block = Window.orderBy("block")
    sums = sums.select("block", (F.sum("own").over(by_block) - F.col("own")).alias("offset"))
    total = w.agg(F.sum("w").alias("total"))  # one row
    inside = w.withColumn("inside", F.sum("w").over(Window.partitionBy("block").orderBy("idx")))
    out = inside.join(sums, "block").join(F.broadcast(total))
    upto = F.col("offset") + F.col("inside")
    return out.select("idx", (upto - F.col("w")).alias("before"), upto.alias("upto"), "total")


@query(CDF + "SELECT idx, round(upto / total, 9) + 0.0 AS cdf FROM cdf")
def cdf_build(spark, sf_dir):
    return cumulative(spark, sf_dir).select("idx", g.rounded(F.col("upto") / F.col("total"), 9).alias("cdf"))


@query(
    CDF + ", u AS (SELECT event_id, CAST(floor(((event_id * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE * (SELECT any_value(total) FROM cdf)) AS BIGINT) AS u FROM events) "
    "SELECT event_id, idx FROM u ASOF JOIN (SELECT idx, upto - CAST(round(p_retailprice * 100) AS BIGINT) AS before FROM cdf JOIN part ON p_partkey = idx) c ON u.u >= c.before"
)
def cdf_sample(spark, sf_dir):
    """Inverse-CDF sampling: each event's uniform number falls into one weight's interval.

    The range join is an equality on coarse buckets: intervals are exploded to the
    buckets they touch, numbers have one bucket each.
    """
    cdf = cumulative(spark, sf_dir)
    total = cdf.agg(F.max("total").alias("all"), F.count("*").alias("n"))  # one row
    u = g.table(spark, sf_dir, "events").select("event_id", F.expr("((event_id * 1103515245L + 12345L) % 2147483648L) / 2147483648.0D").alias("share"))
    u = u.join(F.broadcast(total)).withColumn("u", F.floor(F.col("share") * F.col("all")))
    width = F.greatest(F.lit(1), F.floor(F.col("all") / F.col("n")))
    u = u.select("event_id", "u", F.floor(F.col("u") / width).alias("bucket"))
    cells = cdf.where("upto > before").join(F.broadcast(total)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("upto") - 1) / width))))
    return u.join(cells, "bucket").where("u >= before AND u < upto").select("event_id", "idx")


def sums(spark, sf_dir):
    """(j, v, idx): the same running sums, numbered from 0."""
    cdf = cumulative(spark, sf_dir)
    counts = cdf.groupBy(F.floor(F.col("idx") / 1000).alias("block")).agg(F.count("*").alias("n"))
    counts = counts.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("offset"))
    own = cdf.withColumn("block", F.floor(F.col("idx") / 1000)).withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("idx")) - 1)
    return own.join(counts, "block").select((F.col("offset") + F.col("nth")).alias("j"), F.col("upto").alias("v"), "idx", "total")


def sql_levels(n: int) -> str:
    """CTEs l0 .. l<n-1> of a pyramid over running sums."""
    return ", l0 AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS j, CAST(upto AS DOUBLE) AS v FROM cdf)" + "".join(
        f", l{k} AS (SELECT j // 3 AS j, sum(v) / 3 AS v FROM l{k - 1} GROUP BY j // 3 HAVING count(*) = 3 UNION ALL SELECT count(*) // 3, max(v) FROM l{k - 1})" for k in range(1, n)
    )


@query(CDF + sql_levels(pyramid.LEVELS) + " SELECT level, j, round(v / (SELECT any_value(total) FROM cdf), 9) + 0.0 AS v FROM (" + " UNION ALL ".join(f"SELECT {k} AS level, j, v FROM l{k}" for k in range(pyramid.LEVELS)) + ")")
def msps_build(spark, sf_dir):
    """The pyramid of running sums, each level the three-way means of the one below."""
    levels = pyramid.build(sums(spark, sf_dir), pyramid.LEVELS)
    total = levels[-1].rows.agg(F.max("v").alias("total"))  # one row
    return pyramid.stored(levels).join(F.broadcast(total)).select("level", "j", g.rounded(F.col("v") / F.col("total"), 9).alias("v"))


def jitter(k: int, cast: str) -> str:
    return f"(((event_id * 3 + {k}) * 1103515245{cast} + 12345) % 2147483648{cast}) / 2147483648.0{'D' if cast else '::DOUBLE'}"


@query(
    CDF + ", u AS (SELECT event_id, CAST(floor(((event_id * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE * (SELECT any_value(total) FROM cdf)) AS BIGINT) AS u FROM events) "
    f"SELECT event_id, idx, round(idx % 32 + {jitter(0, '')}, 6) + 0.0 AS x, round(idx // 32 % 32 + {jitter(1, '')}, 6) + 0.0 AS y, round(idx // 1024 + {jitter(2, '')}, 6) + 0.0 AS z "
    "FROM u ASOF JOIN (SELECT idx, upto - CAST(round(p_retailprice * 100) AS BIGINT) AS before FROM cdf JOIN part ON p_partkey = idx) c ON u.u >= c.before"
)
def msps_gen(spark, sf_dir):
    """Points drawn from the weights as an activity on a grid: down the pyramid to a voxel, then somewhere in it."""
    cells = cut(sums(spark, sf_dir))
    levels = pyramid.build(cells)
    total = cells.agg(F.max("total").alias("all"))  # one row
    u = g.table(spark, sf_dir, "events").select("event_id", F.expr("((event_id * 1103515245L + 12345L) % 2147483648L) / 2147483648.0D").alias("share"))
    u = u.join(F.broadcast(total)).select("event_id", (F.floor(F.col("share") * F.col("all")) + 1).alias("u"))
    found = pyramid.descend(u, levels).join(cells.select("j", "idx"), "j")
    place = {"x": "idx % 32", "y": "idx DIV 32 % 32", "z": "idx DIV 1024"}
    return found.select("event_id", "idx", *(g.rounded(F.expr(f"{p} + {jitter(k, 'L')}")).alias(a) for k, (a, p) in enumerate(place.items())))


@query(
    "SELECT c_custkey, CASE WHEN negative THEN '-' ELSE '' END || CASE WHEN abs(v) < 1 THEN printf('%.2f', v) ELSE printf('%.2f ', v / pow(1000, e)) || ['', 'k', 'M', 'G'][e + 1] END AS si FROM "
    "(SELECT c_custkey, round(c_acctbal, 2) < 0 AS negative, round(abs(c_acctbal), 2) AS v, CASE WHEN abs(round(c_acctbal, 2)) >= 1000 THEN 1 ELSE 0 END AS e FROM customer)"
)
def prefix_si(spark, sf_dir):
    """Amounts with the prefixes of thousands; the sign goes first.

    Both roundings take the double for what it is, as printf does: format_string would
    round its shortest decimals up, 8.495 to 8.50 where the number lies below the half.
    """
    cents = F.round(F.col("c_acctbal") * 100) / 100
    v = g.table(spark, sf_dir, "customer").select("c_custkey", (cents < 0).alias("negative"), F.abs(cents).alias("v"))
    e = F.when(F.col("v") >= 1000, 1).otherwise(0)
    fixed = lambda c: F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").otherwise(F.call_function("format_number", c, F.lit("0.00")))
    scaled = F.concat(fixed(F.col("v") / F.pow(F.lit(1000.0), e)), F.lit(" "))
    amount = F.when(F.col("v") < 1, fixed(F.col("v"))).otherwise(F.concat(scaled, F.element_at(F.array(F.lit(""), F.lit("k"), F.lit("M"), F.lit("G")), e + 1)))
    return v.select("c_custkey", F.concat(F.when(F.col("negative"), "-").otherwise(""), amount).alias("si"))


@query(
    "SELECT event_id, concat(CASE WHEN h > 0 THEN printf('%02d h ', h) ELSE '' END, CASE WHEN m > 0 THEN printf('%02d m ', m) ELSE '' END, CASE WHEN s > 0 THEN printf('%02d s ', s) ELSE '' END, printf('%03d ms', ms)) AS t FROM "
    "(SELECT event_id, t // 3600000 AS h, t % 3600000 // 60000 AS m, t % 60000 // 1000 AS s, t % 1000 AS ms FROM (SELECT event_id, event_id * 7919 % 100000000 AS t FROM events))"
)
def time_format(spark, sf_dir):
    """Durations in hours, minutes, seconds and ms; parts that are zero are left out."""
    t = g.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 % 100000000).alias("t"))
    t = t.selectExpr("event_id", "t DIV 3600000 AS h", "t % 3600000 DIV 60000 AS m", "t % 60000 DIV 1000 AS s", "t % 1000 AS ms")
    part = lambda c: F.when(F.col(c) > 0, F.format_string(f"%02d {c} ", c)).otherwise("")
    return t.select("event_id", F.concat(part("h"), part("m"), part("s"), F.format_string("%03d ms", "ms")).alias("t"))


@query(
    "SELECT event_id, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(dz, 6) + 0.0 AS dz FROM (SELECT event_id, sin(t) * cos(p) AS dx, sin(t) * sin(p) AS dy, cos(t) AS dz FROM (SELECT event_id, (event_id % 180) * pi() / 180 AS t, (user_id % 360) * pi() / 180 AS p FROM events))"
)
def deflect(spark, sf_dir):
    """The z direction turned by two angles."""
    a = g.table(spark, sf_dir, "events").select("event_id", F.radians(F.col("event_id") % 180).alias("t"), F.radians(F.col("user_id") % 360).alias("p"))
    return a.select("event_id", g.rounded(F.sin("t") * F.cos("p")).alias("dx"), g.rounded(F.sin("t") * F.sin("p")).alias("dy"), g.rounded(F.cos("t")).alias("dz"))


MOVES = "t AS (SELECT z1 AS z, y2 - y1 AS ty, x2 - x1 AS tx, count(*) AS n FROM lor GROUP BY ALL)"


@query(
    f", {MOVES}, m AS (SELECT a.z, a.ty, a.tx, sum(b.n) AS cons, sum(b.n * sqrt((b.ty - a.ty) ** 2 + (b.tx - a.tx) ** 2)) / sum(b.n) AS err FROM t a JOIN t b ON a.z = b.z AND (b.ty - a.ty) ** 2 + (b.tx - a.tx) ** 2 < 9 GROUP BY a.z, a.ty, a.tx) "
    "SELECT z, ty, tx, round(err, 6) + 0.0 AS err, CAST(cons AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY round(err, 9), ty, tx) AS r FROM m WHERE cons > 2) WHERE r = 1",
    "lor",
)
def ransac_translation(spark, sf_dir):
    """For the lines of each first slice the translation between their ends that fits its consensus best.

    Every line's own translation is tried. Its consensus are the lines whose translation
    is less than 3 away, more than 2 of them; its error is their mean distance, ties go
    to the smaller translation. Lines of equal translation are counted first, and each
    count is handed to the integer translations around it, so lines meet no lines.
    """
    moves = g.lors(spark, sf_dir).groupBy(F.col("z1").alias("z"), (F.col("y2") - F.col("y1")).alias("ty"), (F.col("x2") - F.col("x1")).alias("tx")).agg(F.count("*").alias("n"))
    near = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx < 9]
    around = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((dy * dy + dx * dx) ** 0.5).alias("d")) for dy, dx in near)))
    votes = moves.select("z", "ty", "tx", "n", around.alias("a")).select("z", (F.col("ty") + F.col("a.dy")).alias("ty"), (F.col("tx") + F.col("a.dx")).alias("tx"), "n", "a.d")
    models = votes.groupBy("z", "ty", "tx").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("err")).where("n > 2")
    models = models.join(moves.select("z", "ty", "tx"), ["z", "ty", "tx"], "left_semi")
    best = models.groupBy("z").agg(F.min(F.struct(F.round("err", 9).alias("e"), "ty", "tx", "n", "err")).alias("b"))
    return best.select("z", "b.ty", "b.tx", g.rounded("b.err").alias("err"), "b.n")
