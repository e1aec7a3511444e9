"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def breakpoints(alphabet_size: int) -> list[float]:
    """Standard normal quantiles that cut the axis into equally likely letters."""
    if not 2 <= alphabet_size <= 26:
        raise ValueError("alphabet_size must be between 2 and 26")
    normal = NormalDist()
    return [0.0 if 2 * i == alphabet_size else normal.inv_cdf(i / alphabet_size) for i in range(1, alphabet_size)]


def z_score(value: str, mean: str = "_mean", std: str = "_std") -> Column:
    return F.expr(f"if({std} = 0, 0D, ({value} - {mean}) / {std})")


def letter_sql(z: str, alphabet_size: int) -> str:
    """Letter of a z-score; a value on a breakpoint takes the lower letter."""
    above = "".join(f" + cast({z} > {b!r}D as int)" for b in breakpoints(alphabet_size))
    return f"char(97{above})"


def letter(z: str, alphabet_size: int) -> Column:
    return F.expr(letter_sql(z, alphabet_size))


def uniform(parts: Sequence[Column], draw: int = 0) -> Column:
    """Number in (0, 1) that depends on the row's values, never on its partition.

    52 bits of the MD5 digest of the values as text, joined by bars: any SQL engine can
    repeat it. `draw` 0 and 1 take two independent stretches of one digest.
    """
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1 + 13 * draw, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def standard_normal(parts: Sequence[Column], seed: int | Column) -> Column:
    """Box-Muller draw from the two uniforms of one digest."""
    seeded = [*parts, seed if isinstance(seed, Column) else F.lit(seed)]
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seeded, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seeded, 1))


# The rational approximation 7.1.26 of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, absolute error below 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)
