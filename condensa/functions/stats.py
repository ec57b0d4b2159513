"""Statistics as column expressions: intervals, paired tests, equivalence."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson score interval of k of n; (0, 0) if n is 0."""
    p = k / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (p + z * z / (2 * n) - spread) / (1 + z * z / n), (p + z * z / (2 * n) + spread) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(high, F.lit(1.0))).otherwise(0.0)


def erfc(x: Column, steps: int = 400) -> Column:
    """The complement of the error function for x >= 0: Simpson's rule over 0..x (error below 1e-9); 0 beyond 6."""
    def weighted(k: Column) -> Column:
        t = x * k / steps
        return F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0) * F.exp(-t * t)

    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, k: s + weighted(k)) * x / (3 * steps)
    return F.when(x > 6, 0.0).otherwise(1 - 2 / math.sqrt(math.pi) * area)


def mcnemar_p(b: Column, c: Column) -> Column:
    """The p value of McNemar's test with continuity correction; 1 without discordant pairs."""
    n = (b + c).cast("double")
    stat = (F.abs(b - c) - 1) * (F.abs(b - c) - 1) / n
    return F.when(n == 0, 1.0).otherwise(F.least(erfc(F.sqrt(stat / 2)), F.lit(1.0)))


def draw(n: Column, *key: Column) -> Column:
    """A reproducible whole number below ``n`` from a hash of the key."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long") % n
