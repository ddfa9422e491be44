"""Standard normal distribution as column expressions (Spark has no ``erf``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Hart's rational approximation as published by G. West, "Better approximations to
# cumulative normal functions", Wilmott, 2005. Absolute error below 1e-15.
WEST_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
WEST_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
WEST_SPLIT = 7.07106781186547
SQRT_2PI = 2.5066282746310002


def _horner(x: Column, coefficients) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_pdf(z: Column) -> Column:
    return F.exp(F.lit(-0.5) * z * z) / F.lit(SQRT_2PI)


def normal_cdf(z: Column) -> Column:
    """P(N(0,1) <= z). Give a plain column: it is read several times."""
    x = F.abs(z)
    bell = F.exp(F.lit(-0.5) * x * x)
    near = bell * _horner(x, WEST_NUMERATOR) / _horner(x, WEST_DENOMINATOR)
    fraction = x + F.lit(0.65)
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(step) / fraction
    tail = (
        F.when(x > 37, F.lit(0.0))
        .when(x < F.lit(WEST_SPLIT), near)
        .otherwise(bell / fraction / F.lit(SQRT_2PI))
    )
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def prob_above(mu: Column, var: Column, threshold) -> Column:
    """P(value > threshold) for value ~ N(mu, var); a certain prediction gives 0, 0.5 or 1."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    gap = mu - threshold
    spread = F.sqrt(var)
    sure = F.when(gap > 0, F.lit(1.0)).when(gap < 0, F.lit(0.0)).otherwise(F.lit(0.5))
    return F.when(var == 0, sure).otherwise(normal_cdf(gap / F.nullif(spread, F.lit(0.0))))
