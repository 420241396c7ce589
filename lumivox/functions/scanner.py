"""Scanner geometry and line-of-response geometry as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scanner:
    """Crystals on flat modules around a ring; lengths in mm."""

    columns: int
    rows: int
    modules: int
    pitch_x: float
    pitch_z: float
    half_x: float
    half_z: float
    radius: float
    phase: float
    space_xy: float
    space_z: float
    voxel: float


# The two geometries.
RING_22 = Scanner(22, 29, 28, 4.3, 6.3, 45.15, 88.2, 432.0, 1.5707963267948966, 1004.0, 180.0, 565 / 141)
RING_16 = Scanner(16, 24, 35, 4.9, 6.52, 39.2, 78.24, 440.5, 0.0, 886.0, 183.0, 495 / 127)


def position(s: Scanner, crystal: Column, module: Column) -> tuple[Column, Column, Column]:
    """Centre of a crystal in voxel units of the image space."""
    x = (crystal % s.columns) * s.pitch_x - s.half_x
    z = F.floor(crystal / s.columns) * s.pitch_z - s.half_z
    a = module * (-2 * 3.141592653589793 / s.modules) - s.phase
    return (
        (x * F.cos(a) - s.radius * F.sin(a) + s.space_xy / 2) / s.voxel,
        (-(x * F.sin(a) + s.radius * F.cos(a)) + s.space_xy / 2) / s.voxel,
        (z + s.space_z / 2) / s.voxel,
    )


def positions(events: DataFrame, s: Scanner) -> DataFrame:
    """(lor_id, x1..z2) of coincidences given as crystal and module ids."""
    ends = [(f"{a}{i}", c) for i in "12" for a, c in zip("xyz", position(s, F.col(f"c{i}"), F.col(f"d{i}")))]
    return events.select("lor_id", *(c.alias(n) for n, c in ends))


def clip(lors: DataFrame, border: float, side: float, depth: float) -> DataFrame:
    """Lines cut to the box [border, border + side]^2 x [0, depth] and shifted to its corner.

    Each axis gives an interval of the line's parameter; the line stays if both ends
    of the common interval lie in the box and fall into different voxels. An end on
    the far face moves to the last voxel.
    """
    low, high = {}, {}
    bounds = {"x": (border, border + side), "y": (border, border + side), "z": (0.0, depth)}
    for a, (least, most) in bounds.items():
        d = F.col(f"{a}2") - F.col(f"{a}1")
        near, far = F.try_divide(F.lit(least) - F.col(f"{a}1"), d), F.try_divide(F.lit(most) - F.col(f"{a}1"), d)
        low[a], high[a] = F.coalesce(F.least(near, far), F.lit(float("-inf"))), F.coalesce(F.greatest(near, far), F.lit(float("inf")))
    cut = lors.withColumn("t1", F.greatest(*low.values())).withColumn("t2", F.least(*high.values()))
    ends = {f"{a}{i}": F.round(F.col(f"{a}1") + (F.col(f"{a}2") - F.col(f"{a}1")) * F.col(f"t{i}"), 9) for a in "xyz" for i in "12"}
    cut = cut.select("lor_id", *(c.alias(n) for n, c in ends.items()))
    inside = F.lit(True)
    for a, (least, most) in bounds.items():
        inside = inside & F.col(f"{a}1").between(least, most) & F.col(f"{a}2").between(least, most)
    size = {"x": side, "y": side, "z": depth}
    shifted = {f"{a}{i}": F.col(f"{a}{i}") - bounds[a][0] for a in "xyz" for i in "12"}
    held = {n: F.when(F.floor(c + 0.5) == size[n[0]], size[n[0]] - 1).otherwise(c) for n, c in shifted.items()}
    cut = cut.where(inside).select("lor_id", *(c.alias(n) for n, c in held.items()))
    same = F.lit(True)
    for a in "xyz":
        same = same & (F.floor(f"{a}1") == F.floor(f"{a}2"))
    return cut.where(~same)


def samples_of(lors: DataFrame, width: int, height: int, include_end: bool = False, step: bool = False) -> DataFrame:
    """(lor_id, vox) along each integer line: one voxel a step of the longest axis, in exact integers; with ``step`` its number n, too."""
    steps = F.sequence(F.lit(0), F.col("len") if include_end else F.col("len") - 1)
    rays = lors.where("len > 0").withColumn("n", F.explode(steps))
    place = lambda a: F.col(f"{a}1") + F.floor(F.col("n") * (F.col(f"{a}2") - F.col(f"{a}1")) / F.col("len"))
    return rays.select("lor_id", *["n"] * step, (place("z") * (width * height) + place("y") * width + place("x")).cast("int").alias("vox"))


def pair_id(i: Column, j: Column) -> Column:
    """Unordered pair as one number."""
    high = F.greatest(i, j).cast("long")
    return F.least(i, j).cast("long") + F.floor(high * (high - 1) / 2)


def pair_of(n: Column) -> tuple[Column, Column]:
    """The two members, lower first, of the unordered pair with a number; the inverse of ``pair_id`` for n from 0."""
    guess = F.floor((1 + F.sqrt(8.0 * n + 1)) / 2).cast("long")
    below = lambda k: F.shiftright(k * (k - 1), 1)  # noqa: E731  pairs whose higher member is less
    high = F.when(below(guess) > n, guess - 1).when(below(guess + 1) <= n, guess + 1).otherwise(guess)  # the root may be off by one
    return n - below(high), high


def all_pairs(spark: SparkSession, members: int) -> DataFrame:
    """(n, i1, i2): all pairs i1 < i2 of 0 .. members - 1, ordered by i1, then by i2.

    Numbers are dealt over tasks and each is turned into its pair in closed form:
    counted from the end, pairs are those of ``pair_of``. Nothing is held anywhere.
    """
    total = members * (members - 1) // 2
    low, high = pair_of(F.lit(total - 1) - F.col("id"))
    return spark.range(total).select(F.col("id").alias("n"), (members - 1 - high).alias("i1"), (members - 1 - low).alias("i2"))


def crystal_pairs(spark: SparkSession, s: Scanner, members: int | None = None) -> DataFrame:
    """(n, c1, d1, c2, d2): every line between two of a scanner's crystals, or of its first ``members``."""
    own = s.columns * s.rows
    pairs = all_pairs(spark, own * s.modules if members is None else members)
    ends = [(F.expr(f"i{k} {op} {own}").cast("int")).alias(f"{name}{k}") for k in "12" for name, op in (("c", "%"), ("d", "DIV"))]
    return pairs.select("n", *ends)


def attenuation(hu: Column) -> Column:
    """Linear attenuation at 511 keV from a CT number: water below zero, bone above."""
    return F.when(hu <= 0, 0.096 * (hu + 1000) / 1000).otherwise(0.096 + hu * (0.184 * (0.172 - 0.096)) / (1000 * (0.428 - 0.184)))
