"""Normal and Student tails. Spark has no erf, so erfc is generated once as plain arithmetic.

The same text runs in any SQL engine. Small arguments use the power series (all terms positive),
large ones the continued fraction. The text is long: apply it to aggregated rows only.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES_TERMS = 60
FRACTION_LEVELS = 40
SWITCH = 2.5


def erfc_sql(x: str) -> str:
    """SQL text for erfc of a non-negative column named `x`."""
    sq = f"({x} * {x})"
    coefficients = [4.0 ** n * math.factorial(n) / math.factorial(2 * n + 1)
                    for n in range(SERIES_TERMS)]
    series = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        series = f"({c!r} + {sq} * {series})"
    head = repr(2.0 / math.sqrt(math.pi))
    small = f"(1e0 - {head} * exp(-{sq}) * {x} * {series})"
    fraction = x
    for k in range(FRACTION_LEVELS, 0, -1):
        fraction = f"({x} + {k / 2!r} / {fraction})"
    large = f"(exp(-{sq}) * {1.0 / math.sqrt(math.pi)!r} / {fraction})"
    # literals are doubles in every engine once they carry an exponent
    text = f"CASE WHEN {x} < {SWITCH!r} THEN {small} ELSE {large} END"
    return _as_doubles(text)


def _as_doubles(text: str) -> str:
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?!\d*e)", r"\1e0", text)


def with_p_values(df, z: str = "z", alternative: str = "two-sided", name: str = "p_value"):
    """Add the p-value of column `z`; NULL z gives NULL."""
    scaled = df.withColumn("_x", F.abs(F.col(z)) / math.sqrt(2.0))
    both = scaled.withColumn("_both", F.when(F.col(z).isNotNull(), F.expr(erfc_sql("_x"))))
    tail = F.col("_both") / 2
    if alternative == "two-sided":
        p = F.col("_both")
    elif alternative == "larger":
        p = F.when(F.col(z) >= 0, tail).otherwise(1 - tail)
    elif alternative == "smaller":
        p = F.when(F.col(z) <= 0, tail).otherwise(1 - tail)
    else:
        raise ValueError(f"alternative {alternative!r}")
    p = F.when(F.col(z).isNotNull(), p)
    return both.withColumn(name, p).drop("_x", "_both")


def register_sql(spark, name: str = "erfc") -> None:
    """erfc as a SQL function of the session, for plain SQL users."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE) RETURNS DOUBLE "
              f"RETURN {erfc_sql('x')}")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for i in range(1, 500):
        for top in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)),
                    -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def student_two_sided(t: float, freedom: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    a, b = freedom / 2.0, 0.5
    x = freedom / (freedom + t * t)
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation; runs on the few rows of a correlation table."""
    def one(rho, size):
        if rho is None or math.isnan(rho) or size < 3:
            return None
        rest = 1.0 - rho * rho
        if rest <= 0.0:
            return 0.0
        return student_two_sided(rho * math.sqrt((size - 2) / rest), size - 2)
    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")
