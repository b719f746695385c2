"""Column expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
#: Savitzky-Golay first derivative, window 7, order 3, in 252nds: inside, and for the first and last three samples.
SG_INSIDE = (22, -67, -58, 0, 58, 67, -22)
SG_START = ((-257, 122, 185, 72, -77, -122, 77), (-122, 17, 62, 48, 10, -17, 2), (-29, -46, -19, 24, 55, 46, -31))
SG_END = ((31, -46, -55, -24, 19, 46, 29), (-2, 17, -10, -48, -62, -17, 122), (-77, 122, 77, -72, -185, -122, 257))


def by(*keys: str, order: str = "frame") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def wrap(angle: Column) -> Column:
    """Into [-pi, pi); an angle that is less than -pi by no more than rounding shows becomes pi, as in a floored modulo."""
    turned = angle + math.pi
    return turned - TWO_PI * F.floor(turned / TWO_PI) - math.pi


def unwrap_step(d: Column) -> Column:
    """What is added to all later angles after a difference d: whole turns, none for less than half a turn."""
    m = wrap(d)
    m = F.when((m == -math.pi) & (d > 0), math.pi).otherwise(m)
    return F.when(F.abs(d) < math.pi, 0.0).otherwise(m - d)


def gradient(x: Column, dt: float, w: WindowSpec) -> Column:
    """Central differences, one-sided at the ends; null for a single sample."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull(), (after - x) / dt).when(after.isNull(), (x - before) / dt).otherwise((after - before) / (2 * dt))


def sg_derivative(x: Column, i: Column, n: Column, w: WindowSpec) -> Column:
    """Savitzky-Golay slope per sample at sample i of n; null for fewer than seven samples."""

    def taps(c, first: int) -> Column:
        total = None
        for k, v in enumerate(c):
            at = first + k
            if v:
                term = v * (F.lead(x, at).over(w) if at > 0 else F.lag(x, -at).over(w) if at < 0 else x)
                total = term if total is None else total + term
        return total / 252.0

    out = F.when(n < 7, F.lit(None).cast("double"))
    for k in range(3):
        out = out.when(i == k, taps(SG_START[k], -k)).when(i == n - 3 + k, taps(SG_END[k], -4 - k))
    return out.otherwise(taps(SG_INSIDE, -3))


def lerp_at(values: Column, at: Column) -> Column:
    """A value of an array at a fractional index, clamped at both ends."""
    last = F.size(values) - 1
    lo = F.greatest(F.lit(0), F.least(F.floor(at).cast("int"), last))
    hi = F.least(lo + 1, last)
    a, b = F.get(values, lo), F.get(values, hi)
    share = F.least(F.greatest(at - lo, F.lit(0.0)), F.lit(1.0))
    return F.when(share == 0, a).otherwise(a + (b - a) * share)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def packed(value: str, order: str = "k") -> Column:
    """Aggregate: the group's values as an array, sorted by ``order``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
