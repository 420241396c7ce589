"""Discrete Fourier transforms and what is built on them.

Grids of one key are small and bounded by their sizes; keys are many. So each key's
grid is gathered by one shuffle and transformed by numpy in its group, in Arrow
batches; everything after that is projections, joins and grouped sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.operators.samples import distance


def transformed(samples: DataFrame, key: str, axes: Sequence[str], size: int, inverse: bool = False) -> DataFrame:
    """(key, k<axis>.., re, im), zero frequency at size // 2; or back, to (key, axes.., v) as moduli."""
    out_axes = list(axes) if inverse else [f"k{a}" for a in axes]
    in_axes = [f"k{a}" for a in axes] if inverse else list(axes)
    values = ["re", "im"] if inverse else ["v"]
    schema = f"{key} long, " + ", ".join(f"{a} int" for a in out_axes) + (", v double" if inverse else ", re double, im double")
    shape = (size,) * len(axes)

    def run(rows: pa.Table) -> pa.Table:
        at = tuple(rows.column(a).to_numpy() for a in in_axes)
        cube = np.zeros(shape, complex)
        cube[at] = rows.column("re").to_numpy() + 1j * rows.column("im").to_numpy() if inverse else rows.column("v").to_numpy()
        found = np.abs(np.fft.ifftn(np.fft.ifftshift(cube))) if inverse else np.fft.fftshift(np.fft.fftn(cube))
        places = [p.ravel().astype(np.int32) for p in np.indices(shape)]
        results = [found.ravel()] if inverse else [found.real.ravel(), found.imag.ravel()]
        ids = np.full(found.size, rows.column(key)[0].as_py(), np.int64)
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in (ids, *places, *results)], [key, *out_axes, *(["v"] if inverse else ["re", "im"])])

    return samples.select(F.col(key).cast("long").alias(key), *in_axes, *values).groupBy(key).applyInArrow(run, schema)


def power(spectrum: DataFrame, count: int) -> DataFrame:
    """|F|^2 / number of samples, as v."""
    return spectrum.withColumn("v", (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / count).drop("re", "im")


def filtered(samples: DataFrame, key: str, axes: Sequence[str], size: int, transfer) -> DataFrame:
    """abs(ifft(fft * H)); H is a function of the frequency r / size."""
    spectrum = transformed(samples, key, axes, size)
    k = [f"k{a}" for a in axes]
    h = transfer(distance(k, [size // 2] * len(k)) / size)
    return transformed(spectrum.withColumns({"re": F.col("re") * h, "im": F.col("im") * h}), key, axes, size, inverse=True)


def ring_correlation(first: DataFrame, second: DataFrame, key: str, axes: Sequence[str], size: int) -> DataFrame:
    """Fourier ring or shell correlation: cross power over the root of both powers, by radius."""
    k = [f"k{a}" for a in axes]
    pair = first.join(second.select(key, *k, F.col("re").alias("re2"), F.col("im").alias("im2")), [key, *k])
    r = pair.withColumn("r", distance(k, [size // 2] * len(k))).withColumn("low", F.floor("r").cast("int")).where(F.col("low") <= size // 2)
    share = F.col("r") - F.col("low")
    parts = F.array(F.struct(F.col("low").alias("bin"), (1 - share).alias("w")), F.struct((F.col("low") + 1).alias("bin"), share.alias("w")))
    rings = r.withColumn("p", F.explode(parts)).where((F.col("p.bin") <= size // 2) & (F.col("p.w") > 0))
    weigh = lambda x: F.sum(F.col("p.w") * x)
    cross = weigh(F.col("re") * F.col("re2") + F.col("im") * F.col("im2"))
    powers = weigh(F.col("re") ** 2 + F.col("im") ** 2) * weigh(F.col("re2") ** 2 + F.col("im2") ** 2)
    return rings.groupBy(key, F.col("p.bin").alias("bin")).agg(F.try_divide(cross, F.sqrt(powers)).alias("val"))
