"""Operators on sampled images and volumes: one implementation for two and three axes.

Samples are rows (key, axes..., v). ``axes`` is ("y", "x") or ("z", "y", "x").
Arguments that are sizes are those of the full grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.grid import dense


def project(samples: DataFrame, key: str, keep: Sequence[str], how=F.sum) -> DataFrame:
    """Reduce all axes that are not kept: sums, or maximum and minimum intensity."""
    return samples.groupBy(key, *keep).agg(how("v").alias("v"))


def statistics(samples: DataFrame, key: str) -> DataFrame:
    """Least, largest and mean value, population deviation, sum and number of samples."""
    return samples.groupBy(key).agg(
        F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.sum("v").alias("total"), F.count("*").alias("n")
    )


def z_score(samples: DataFrame, key: str) -> DataFrame:
    """(v - mean) / population deviation of each key; 0 where all values are equal."""
    stats = samples.groupBy(key).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    scaled = F.coalesce(F.try_divide(F.col("v") - F.col("mean"), F.col("std")), F.lit(0.0))
    return samples.join(stats, key).withColumn("v", scaled).drop("mean", "std")


def min_max(samples: DataFrame, key: str) -> DataFrame:
    """Values scaled to 0..1 within each key."""
    stats = samples.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    scaled = F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return samples.join(stats, key).withColumn("v", scaled).drop("low", "high")


def moved(samples: DataFrame, **places: Column | str) -> DataFrame:
    """New coordinates as expressions of the old ones, all taken before the move."""
    new = {axis: (F.expr(c) if isinstance(c, str) else c).cast("int") for axis, c in places.items()}
    return samples.select(*(new[c].alias(c) if c in new else F.col(c) for c in samples.columns))


def centroid(samples: DataFrame, key: str, axes: Sequence[str]) -> DataFrame:
    """Centre of mass along each axis; null if the values sum to zero."""
    return samples.groupBy(key).agg(*(F.try_divide(F.sum(F.col(a) * F.col("v")), F.sum("v")).alias(f"c{a}") for a in axes))


def distance(axes: Sequence[str], centre: Sequence[float]) -> Column:
    return F.sqrt(sum((F.pow(F.col(a) - F.lit(c), 2) for a, c in zip(axes, centre)), F.lit(0.0)))


def correlation(pairs: DataFrame, key: str) -> DataFrame:
    """Zero-mean normalised cross correlation of v1 and v2."""
    return pairs.groupBy(key).agg(F.corr("v1", "v2").alias("zncc"))


def snr(zncc: Column) -> Column:
    """Signal to noise from a correlation: sqrt(c / (1 - c)); null outside [0, 1)."""
    ratio = F.try_divide(zncc, 1 - zncc)
    return F.when(ratio >= 0, F.sqrt(ratio))


def radial_average(samples: DataFrame, key: str, axes: Sequence[str], size: int) -> DataFrame:
    """Mean over rings or shells: each sample is shared by the two radii around it.

    Radii beyond ``size // 2`` are left out; freq is radius / size.
    """
    centre, rim = [size // 2] * len(axes), size // 2
    r = samples.withColumn("r", distance(axes, centre)).withColumn("low", F.floor("r").cast("int"))
    share = F.col("r") - F.col("low")
    parts = F.array(F.struct(F.col("low").alias("bin"), (1 - share).alias("w")), F.struct((F.col("low") + 1).alias("bin"), share.alias("w")))
    shared = r.where(F.col("low") <= rim).select(key, "v", F.explode(parts).alias("p")).select(key, "v", "p.bin", "p.w").where((F.col("bin") <= rim) & (F.col("w") > 0))
    return shared.groupBy(key, "bin").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("val")).withColumn("freq", F.col("bin") / size)


def neighbourhood(samples: DataFrame, axes: Sequence[str], reach: int) -> DataFrame:
    """Each sample's value handed to every place that has it in its window: (places, dy.., v).

    A shift is a projection and the regrouping one hash shuffle; no self-join is needed.
    """
    out = samples
    for a in axes:
        out = out.withColumn(f"d{a}", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(a, F.col(a) + F.col(f"d{a}"))
    return out


def windows(samples: DataFrame, key: str, axes: Sequence[str], width: int, sizes: Sequence[int]) -> DataFrame:
    """(places, lo, m, hi): least, middle and largest value of every full width^n window."""
    reach, inner, n = width // 2, F.lit(True), width ** len(axes)
    for a, size in zip(axes, sizes):
        inner = inner & F.col(a).between(reach, size - 1 - reach)
    found = neighbourhood(samples, axes, reach).where(inner).groupBy(key, *axes).agg(F.array_sort(F.collect_list("v")).alias("w")).where(F.size("w") == n)
    return found.select(key, *axes, F.col("w")[0].alias("lo"), F.col("w")[n // 2].alias("m"), F.col("w")[n - 1].alias("hi"))


def adaptive_median(samples: DataFrame, key: str, axes: Sequence[str], width: int, most: int, sizes: Sequence[int]) -> DataFrame:
    """Medians over windows that grow from ``width`` to ``most`` by two, each pass over what the last one left.

    A value stays if it and the median lie strictly inside its window's range, or if its window is not full.
    """
    for w in range(width, most + 1, 2):
        keep = F.expr("m IS NULL OR (v > lo AND v < hi AND m > lo AND m < hi)")
        found = samples.join(windows(samples, key, axes, w, sizes), [key, *axes], "left")
        samples = found.select(key, *axes, F.when(keep, F.col("v")).otherwise(F.col("m")).alias("v"))
    return samples


def median_filter(samples: DataFrame, key: str, axes: Sequence[str], width: int, sizes: Sequence[int]) -> DataFrame:
    """Median of the width^n window; places whose window leaves the grid, or lacks samples, have 0."""
    medians = windows(samples, key, axes, width, sizes).select(key, *axes, "m")
    return samples.join(medians, [key, *axes], "left").select(key, *axes, F.coalesce("m", F.lit(0.0)).alias("v"))


def convolve(samples: DataFrame, key: str, axes: Sequence[str], weight: Column, reach: int, sizes: Sequence[int]) -> DataFrame:
    """Weighted sum over the window; ``weight`` is an expression of d<axis>; zero outside the grid."""
    inside = F.lit(True)
    for a, n in zip(axes, sizes):
        inside = inside & F.col(a).between(0, n - 1)
    return neighbourhood(samples, axes, reach).where(inside).groupBy(key, *axes).agg(F.sum(F.col("v") * weight).alias("v"))


def convolve_inside(samples: DataFrame, key: str, axes: Sequence[str], weight: Column, reach: int, sizes: Sequence[int]) -> DataFrame:
    """Weighted sum over the window where it lies in the grid as a whole; 0 at the other samples."""
    inside = F.lit(True)
    for a, n in zip(axes, sizes):
        inside = inside & F.col(a).between(reach, n - 1 - reach)
    sums = neighbourhood(samples, axes, reach).where(inside).groupBy(key, *axes).agg(F.sum(F.col("v") * weight).alias("sum"))
    return samples.join(sums, [key, *axes], "left").select(key, *axes, F.coalesce("sum", F.lit(0.0)).alias("v"))


def packed_cube(samples: DataFrame, spark: SparkSession, key: str, sizes: tuple[int, int, int]) -> DataFrame:
    """Each volume of the sizes nz, ny, nx in the middle of a cube of zeros with its longest edge."""
    edge = max(sizes)
    shifts = {a: f"{a} + {(edge - n) // 2}" for a, n in zip("zyx", sizes)}
    return dense(moved(samples, **shifts), spark, key, z=edge, y=edge, x=edge)


def sinc(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-12, 1.0).otherwise(F.sin(F.lit(3.141592653589793) * x) / (F.lit(3.141592653589793) * x))


def lanczos(samples: DataFrame, key: str, axes: Sequence[str], old: Sequence[int], new: Sequence[int], a: int) -> DataFrame:
    """Resample by Lanczos-a, backwards and axis by axis; taps outside count as zero.

    The kernel is separable, so each axis is one small table of (source, target,
    weight) that is exploded beside the samples: 2a rows a sample instead of (2a)^n.
    """
    out = samples
    for axis, n, m in zip(axes, old, new):
        taps = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda t: F.struct(t.alias("t"), (t * F.lit(n / m)).alias("s")))  # noqa: B023
        spread = out.withColumn("tap", F.explode(taps)).select(*out.columns, F.col("tap.t").alias("t"), F.col("tap.s").alias("s"))
        near = (F.col(axis) > F.floor("s") - a) & (F.col(axis) <= F.floor("s") + a)
        delta = F.col("s") - F.col(axis)
        rest = [x for x in axes if x != axis]
        out = spread.where(near).groupBy(key, *rest, F.col("t").alias(axis)).agg(F.sum(F.col("v") * sinc(delta) * sinc(delta / a)).alias("v"))
    return out
