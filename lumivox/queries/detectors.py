"""Queries on detector words, events and line geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumivox import grid as g
from lumivox.functions import scanner as sc
from lumivox.queries import query

BLF = (
    "SELECT event_id, CAST(id1 % 16 + 16 * r1 AS INTEGER) AS c1, CAST(id1 // 16 AS INTEGER) AS m1, CAST(id2 % 16 + 16 * r2 AS INTEGER) AS c2, CAST(id2 // 16 AS INTEGER) AS m2 FROM ("
    "SELECT event_id, (w >> 21) & 1023 AS id1, (w >> 16) & 31 AS r1, (w >> 5) & 1023 AS id2, w & 31 AS r2, w >> 31 AS kind FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS w FROM events)) "
    "WHERE kind = 0 AND r1 < 24 AND r2 < 24 AND id1 // 16 < 35 AND id2 // 16 < 35"
)


@query(BLF)
def blf_decode(spark, sf_dir):
    """Packed detector words to crystals and modules; words of other kinds or places are dropped."""
    w = g.table(spark, sf_dir, "events").select("event_id", F.expr("(event_id * 2654435761L) % 4294967296L").alias("w"))
    bits = lambda at, n: F.shiftright("w", at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    parts = w.where(bits(31, 1) == 0).select("event_id", bits(21, 10).alias("id1"), bits(16, 5).alias("r1"), bits(5, 10).alias("id2"), bits(0, 5).alias("r2"))
    kept = parts.where("r1 < 24 AND r2 < 24 AND id1 DIV 16 < 35 AND id2 DIV 16 < 35")
    return kept.selectExpr(
        "event_id", "CAST(id1 % 16 + 16 * r1 AS INT) AS c1", "CAST(id1 DIV 16 AS INT) AS m1", "CAST(id2 % 16 + 16 * r2 AS INT) AS c2", "CAST(id2 DIV 16 AS INT) AS m2"
    )


def positions_sql(s: sc.Scanner, crystals: int, detectors: int, digits: int | None) -> str:
    def end(i: str) -> str:
        x = f"((c{i} % {s.columns}) * {s.pitch_x} - {s.half_x})::DOUBLE"
        z = f"(floor(c{i} / {s.columns}) * {s.pitch_z}::DOUBLE - {s.half_z}::DOUBLE)"
        a = f"(d{i} * (-2 * pi() / {s.modules}) - {s.phase}::DOUBLE)"
        both = [f"({x} * cos({a}) - {s.radius} * sin({a}) + {s.space_xy / 2}) / {s.voxel!r}::DOUBLE", f"(-({x} * sin({a}) + {s.radius} * cos({a})) + {s.space_xy / 2}) / {s.voxel!r}::DOUBLE", f"({z} + {s.space_z / 2}) / {s.voxel!r}::DOUBLE"]
        return ", ".join(f"{f'round({c}, {digits}) + 0.0' if digits else c} AS {n}{i}" for n, c in zip("xyz", both))

    return (
        f"SELECT lor_id, {end('1')}, {end('2')} FROM (SELECT o_orderkey AS lor_id, CAST(o_orderkey % {crystals} AS INTEGER) AS c1, CAST(o_custkey % {detectors} AS INTEGER) AS d1, "
        f"CAST((o_orderkey * 7 + 11) % {crystals} AS INTEGER) AS c2, CAST((o_custkey * 5 + 3) % {detectors} AS INTEGER) AS d2 FROM orders)"
    )


ENDS = ("x1", "y1", "z1", "x2", "y2", "z2")


@query(positions_sql(sc.RING_22, 638, 28, 6))
def idtopos_ring22(spark, sf_dir):
    return sc.positions(g.detector_events(spark, sf_dir), sc.RING_22).withColumns({c: g.rounded(c) for c in ENDS})


@query(positions_sql(sc.RING_16, 384, 35, 6))
def idtopos_ring16(spark, sf_dir):
    return sc.positions(g.detector_events(spark, sf_dir, 384, 35), sc.RING_16).withColumns({c: g.rounded(c) for c in ENDS})


def clip_sql() -> str:
    box = {"x": (55, 196), "y": (55, 196), "z": (0, 45)}
    near = lambda a, m: f"CASE WHEN {a}2 = {a}1 THEN NULL ELSE ({m} - {a}1) / ({a}2 - {a}1) END"
    t1 = "greatest(" + ", ".join(f"coalesce(least({near(a, lo)}, {near(a, hi)}), '-infinity'::DOUBLE)" for a, (lo, hi) in box.items()) + ")"
    t2 = "least(" + ", ".join(f"coalesce(greatest({near(a, lo)}, {near(a, hi)}), 'infinity'::DOUBLE)" for a, (lo, hi) in box.items()) + ")"
    ends = ", ".join(f"round({a}1 + ({a}2 - {a}1) * t{i}, 9) AS {a}{i}" for a in "xyz" for i in "12")
    inside = " AND ".join(f"{a}{i} BETWEEN {lo} AND {hi}" for a, (lo, hi) in box.items() for i in "12")
    size = {"x": 141, "y": 141, "z": 45}
    held = ", ".join(f"CASE WHEN floor({a}{i} - {box[a][0]} + 0.5) = {size[a]} THEN {size[a] - 1} ELSE {a}{i} - {box[a][0]} END AS {a}{i}" for a in "xyz" for i in "12")
    same = " AND ".join(f"floor({a}1) = floor({a}2)" for a in "xyz")
    return (
        f"WITH pos AS ({positions_sql(sc.RING_22, 638, 28, None)}), t AS (SELECT *, {t1} AS t1, {t2} AS t2 FROM pos), cut AS (SELECT lor_id, {ends} FROM t), "
        f"held AS (SELECT lor_id, {held} FROM cut WHERE {inside}), clipped AS (SELECT * FROM held WHERE NOT ({same})) "
    )


@query(clip_sql() + "SELECT lor_id, " + ", ".join(f"round({c} + 1e-8, 5) + 0.0 AS {c}" for c in ENDS) + " FROM clipped")
def raycast_clip(spark, sf_dir):
    found = sc.clip(sc.positions(g.detector_events(spark, sf_dir), sc.RING_22), 55, 141, 45)
    # ends have nine digits; a hair more keeps them from halfway between two of five digits
    return found.select("lor_id", *(g.rounded(F.col(c) + 1e-8, 5).alias(c) for c in ENDS))


@query(clip_sql() + "SELECT lor_id, " + ", ".join(f"CAST(floor({c}) AS INTEGER) AS {c}" for c in ENDS) + " FROM clipped")
def clean_lor(spark, sf_dir):
    """Clipped lines as whole voxels."""
    found = sc.clip(sc.positions(g.detector_events(spark, sf_dir), sc.RING_22), 55, 141, 45)
    return found.select("lor_id", *(F.floor(c).cast("int").alias(c) for c in ENDS))


@query(
    "SELECT lor_id, least(a, b) + greatest(a, b) * (greatest(a, b) - 1) // 2 AS pair FROM (SELECT lor_id, CAST(c1 * 28 + d1 AS BIGINT) AS a, CAST(c2 * 28 + d2 AS BIGINT) AS b FROM event)", "event"
)
def lor_pair_id(spark, sf_dir):
    e = g.detector_events(spark, sf_dir)
    return e.select("lor_id", sc.pair_id(F.col("c1") * 28 + F.col("d1"), F.col("c2") * 28 + F.col("d2")).alias("pair"))


@query("SELECT CAST(l_suppkey % 16 AS INTEGER) AS id1, CAST(l_partkey % 16 AS INTEGER) AS id2, count(*) AS val FROM lineitem GROUP BY ALL")
def lor_bin_counts(spark, sf_dir):
    ids = g.table(spark, sf_dir, "lineitem").selectExpr("CAST(l_suppkey % 16 AS INT) AS id1", "CAST(l_partkey % 16 AS INT) AS id2")
    return ids.groupBy("id1", "id2").agg(F.count("*").alias("val"))


@query("SELECT d1, n, n * (n - 1) // 2 AS pairs FROM (SELECT d1, count(DISTINCT c1) AS n FROM event GROUP BY d1)", "event")
def all_lor_count(spark, sf_dir):
    """Number of crystals seen in each module, and of lines between any two of them."""
    seen = g.detector_events(spark, sf_dir).groupBy("d1").agg(F.countDistinct("c1").alias("n"))
    return seen.withColumn("pairs", F.expr("n * (n - 1) DIV 2"))


@query("SELECT p_partkey, round(CASE WHEN hu <= 0 THEN 0.096 * (hu + 1000) / 1000 ELSE 0.096 + hu * (0.184 * (0.172 - 0.096)) / (1000 * (0.428 - 0.184)) END::DOUBLE, 6) + 0.0 AS mu FROM (SELECT p_partkey, p_size * 60 - 1000 AS hu FROM part)")
def ct_to_mumap(spark, sf_dir):
    hu = F.col("p_size") * 60 - 1000
    return g.table(spark, sf_dir, "part").select("p_partkey", g.rounded(sc.attenuation(hu)).alias("mu"))


@query("SELECT CAST(floor(y1) AS INTEGER) AS y, CAST(floor(x1) AS INTEGER) AS x, count(*) AS n FROM lor GROUP BY ALL", "lor")
def point_hist_2d(spark, sf_dir):
    return g.lors(spark, sf_dir).select(F.col("y1").alias("y"), F.col("x1").alias("x")).groupBy("y", "x").agg(F.count("*").alias("n"))


@query("SELECT z1 AS z, y1 AS y, x1 AS x, count(*) AS n FROM lor GROUP BY ALL", "lor")
def point_hist_3d(spark, sf_dir):
    return g.lors(spark, sf_dir).select(F.col("z1").alias("z"), F.col("y1").alias("y"), F.col("x1").alias("x")).groupBy("z", "y", "x").agg(F.count("*").alias("n"))


@query("SELECT vox % 1024 AS pix, count(*) AS n FROM ray GROUP BY ALL", "lor", "ray")
def lines_dda_2d(spark, sf_dir):
    """All lines drawn on one 32 x 32 image."""
    return sc.samples_of(g.lors(spark, sf_dir), 32, 32).groupBy((F.col("vox") % 1024).alias("pix")).agg(F.count("*").alias("n"))


@query("SELECT vox, count(*) AS n FROM ray GROUP BY ALL", "lor", "ray")
def lines_dda_3d(spark, sf_dir):
    return sc.samples_of(g.lors(spark, sf_dir), 32, 32).groupBy("vox").agg(F.count("*").alias("n"))


@query(
    ", s AS (SELECT lor_id, len, x1, x2, y1, y2, unnest(range(0, len + 1)) AS n FROM lor), p AS (SELECT *, n * (x2 - x1) % len AS fx, n * (y2 - y1) % len AS fy, x1 + floor(n * (x2 - x1) / len) AS x, y1 + floor(n * (y2 - y1) / len) AS y FROM s WHERE abs(x2 - x1) >= abs(y2 - y1) AND x1 <> x2) "
    "SELECT CAST(yy AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(w), 6) + 0.0 AS v FROM (SELECT x, y AS yy, 1 - f AS w FROM (SELECT *, (n * (y2 - y1) / abs(x2 - x1)) - floor(n * (y2 - y1) / abs(x2 - x1)) AS f FROM "
    "(SELECT lor_id, x1, x2, y1, y2, n, x1 + n * sign(x2 - x1) AS x, y1 + floor(n * (y2 - y1) / abs(x2 - x1)) AS y FROM p WHERE n <= abs(x2 - x1)) a) UNION ALL SELECT x, y + 1, f FROM (SELECT *, (n * (y2 - y1) / abs(x2 - x1)) - floor(n * (y2 - y1) / abs(x2 - x1)) AS f FROM "
    "(SELECT lor_id, x1, x2, y1, y2, n, x1 + n * sign(x2 - x1) AS x, y1 + floor(n * (y2 - y1) / abs(x2 - x1)) AS y FROM p WHERE n <= abs(x2 - x1)) b)) WHERE w > 0 GROUP BY ALL",
    "lor",
)
def lines_aa_2d(spark, sf_dir):
    """Anti-aliased lines of the flat kind: each column shares its weight between two rows."""
    flat = g.lors(spark, sf_dir).where("abs(x2 - x1) >= abs(y2 - y1) AND x1 <> x2").withColumn("n", F.explode(F.expr("sequence(0, abs(x2 - x1))")))
    at = flat.withColumn("exact", F.expr("n * (y2 - y1) / abs(x2 - x1)")).withColumn("f", F.col("exact") - F.floor("exact"))
    cells = at.select(F.expr("CAST(x1 + n * sign(x2 - x1) AS INT)").alias("x"), (F.col("y1") + F.floor("exact")).cast("int").alias("y"), "f")
    both = F.array(F.struct(F.col("y").alias("y"), (1 - F.col("f")).alias("w")), F.struct((F.col("y") + 1).alias("y"), F.col("f").alias("w")))
    return cells.select("x", F.explode(both).alias("p")).where("p.w > 0").groupBy("p.y", "x").agg(g.rounded(F.sum("p.w")).alias("v"))


@query(
    ", c AS (SELECT lor_id, x1, y1, z1, x2, y2, z2, a FROM lor, range(1, 32) t(k), (VALUES (0), (1), (2)) ax(i), LATERAL (SELECT CASE i WHEN 0 THEN (k - x1 - 0.5) / nullif(x2 - x1, 0) WHEN 1 THEN (k - y1 - 0.5) / nullif(y2 - y1, 0) ELSE (k - z1 - 0.5) / nullif(z2 - z1, 0) END AS a) q "
    "WHERE a > 0 AND a < 1 UNION SELECT lor_id, x1, y1, z1, x2, y2, z2, 0.0 FROM lor UNION SELECT lor_id, x1, y1, z1, x2, y2, z2, 1.0 FROM lor), "
    "d AS (SELECT *, lag(a) OVER (PARTITION BY lor_id ORDER BY a) AS b FROM c) SELECT lor_id, count(*) AS n, round(max(a - b) * sqrt(any_value((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1))), 6) + 0.0 AS longest FROM d WHERE a - b > 1e-9 GROUP BY lor_id",
    "lor",
)
def siddon_lengths(spark, sf_dir):
    """Path lengths through voxels: crossings of all planes in order, and their differences."""
    return path_lengths(g.lors(spark, sf_dir)).groupBy("lor_id").agg(F.count("*").alias("n"), g.rounded(F.max("w")).alias("longest"))


def path_lengths(lors):
    """(lor_id, mid parameter, w): lengths between successive plane crossings of lines through voxel centres."""
    ends = [F.array(F.lit(0.0), F.lit(1.0))]
    for a in "xyz":
        d = F.col(f"{a}2") - F.col(f"{a}1")
        planes = F.sequence(F.least(f"{a}1", f"{a}2") + 1, F.greatest(f"{a}1", f"{a}2"))
        crossed = F.transform(planes, lambda k: (k - F.col(f"{a}1") - 0.5) / d)  # noqa: B023
        ends.append(F.when(d != 0, crossed).otherwise(F.array().cast("array<double>")))
    cuts = F.array_sort(F.array_distinct(F.concat(*ends)))
    length = F.sqrt(sum((F.pow(F.col(f"{a}2") - F.col(f"{a}1"), 2) for a in "xyz"), F.lit(0.0)))
    steps = lors.withColumn("cuts", cuts).withColumn("length", length)
    pairs = F.expr("zip_with(slice(cuts, 1, size(cuts) - 1), slice(cuts, 2, size(cuts) - 1), (b, a) -> struct(b, a))")
    return steps.select("lor_id", "length", F.explode(pairs).alias("p")).where("p.a - p.b > 1e-9").select("lor_id", ((F.col("p.a") + F.col("p.b")) / 2).alias("mid"), ((F.col("p.a") - F.col("p.b")) * F.col("length")).alias("w"))
