"""Transfer functions of frequency filters, as expressions of the frequency f = r / size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumivox.operators.samples import sinc


def gaussian(f: Column, sigma: float) -> Column:
    return F.exp(-(f * f) / (2 * sigma * sigma))


def metz(f: Column, order: int, sigma: float) -> Column:
    low = gaussian(f, sigma)
    return (1 - F.pow(1 - low * low, F.lit(order + 1))) / low


def butterworth_lp(f: Column, order: int, cut: float) -> Column:
    return 1 / F.sqrt(1 + F.pow(f / cut, F.lit(2 * order)))


def butterworth_hp(f: Column, order: int, cut: float) -> Column:
    """The low pass mirrored at half the sampling frequency."""
    return 1 / F.sqrt(1 + F.pow((0.5 - f) / (0.5 - cut), F.lit(2 * order)))


def butterworth_bp(f: Column, order: int, low: float, high: float) -> Column:
    return butterworth_lp(f, order, high) * butterworth_hp(f, order, low)


def tanh_lp(f: Column, slope: float, cut: float) -> Column:
    return 0.5 - 0.5 * F.tanh(F.lit(3.141592653589793) * (f - cut) / (2 * slope * cut))


def tanh_hp(f: Column, slope: float, cut: float) -> Column:
    return 1 - tanh_lp(f, slope, cut)


def lanczos(f: Column, a: int) -> Column:
    scaled = f * 2 * a
    return sinc(scaled) * sinc(scaled / a)
