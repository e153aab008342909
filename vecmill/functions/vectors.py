"""Vector and partition-statistics expressions on array<double> columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(v: Column) -> Column:
    """Elements as doubles: distances are always summed in double precision."""
    return v.cast("array<double>")


def narrow(v: Column) -> Column:
    """Elements as 32-bit floats."""
    return v.cast("array<float>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_norm(x: Column) -> Column:
    return dot(x, x)


def squared_l2(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def subtract(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def scale(x: Column, by: Column) -> Column:
    return F.transform(x, lambda a: a * by)


def midpoint(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: (a + b) * 0.5)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once however often f names it: inside a lambda Spark shares no expression, and takes it anew for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def unit(x: Column) -> Column:
    """x over its norm; a zero vector stays."""
    over = lambda v, norm: _once(1.0 / F.when(norm == 0, 1.0).otherwise(norm), lambda by: scale(v, by))
    return _once(x, lambda v: _once(F.sqrt(squared_norm(v)), lambda norm: over(v, norm)))


def angle(similarity: Column) -> Column:
    """Angular distance of a cosine, kept off the ends of arccos."""
    return F.acos(F.greatest(F.least(similarity, F.lit(1 - EPS)), F.lit(-1 + EPS)))


def boundary_score(nearest: Column, second: Column) -> Column:
    """1 on the boundary of two partitions, 0 at a centroid."""
    return nearest / (second + EPS)


def stay_gain(n: Column, s: Column, xa: Column, rho: Column) -> Column:
    """What a point is worth to the partition (n members, s the squared norm of their sum) that it is in; xa = <x, sum>."""
    return F.when(n <= 1, 0.0).otherwise(s / n - (s - 2 * xa + rho) / (n - 1))


def join_gain(n: Column, s: Column, xa: Column, rho: Column) -> Column:
    """What a point would add to a partition that it isn't in."""
    return (s + 2 * xa + rho) / (n + 1) - F.when(n > 0, s / n).otherwise(0.0)


def move_delta(n1: Column, s1: Column, xa1: Column, n2: Column, s2: Column, xa2: Column, rho: Column, same: Column) -> Column:
    """Change of the sum of s/n when a point moves from partition 1 to 2; 0 inside one partition or from a singleton."""
    before = s1 / n1 + F.when(n2 > 0, s2 / n2).otherwise(0.0)
    after = (s1 - 2 * xa1 + rho) / (n1 - 1) + (s2 + 2 * xa2 + rho) / (n2 + 1)
    return F.when(same | (n1 <= 1), 0.0).otherwise(after - before)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ratio(a: Column, b: Column) -> Column:
    """Speed-up of b over a; null where b is 0."""
    return F.when(b != 0, a / b)


def millis(micros: Column) -> Column:
    return micros / 1000.0


def percent(share: Column) -> Column:
    return share * 100.0
