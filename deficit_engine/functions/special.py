"""Special functions as column expressions: log-gamma, incomplete beta, F distribution.

Spark has none of these. They are built from its own arithmetic and higher-order
functions, so they run inside the executors on any number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 10          # arguments are raised by this before Stirling's series
TERMS = 150         # steps of the continued fraction: enough for parameters up to some 10,000
HALVINGS, STEPS = 20, 8     # of the interval that holds a quantile, and Newton's steps after them


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def log_gamma(x) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at
    x + SHIFT, stepped down by gamma(y + 1) = y gamma(y)."""
    x = _c(x)
    y = x + SHIFT
    inverse = 1 / (y * y)
    # Bernoulli numbers over 2k (2k - 1)
    series = (1 / 12.0 - inverse * (1 / 360.0 - inverse * (1 / 1260.0 - inverse * (1 / 1680.0 - inverse / 1188.0)))) / y
    steps = sum((F.log(x + k) for k in range(1, SHIFT)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def step(state: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        turned = _let(F.when(k % 2 == 0, even).otherwise(odd),
                      lambda t: F.struct((1 / safe(1 + t * state["d"])).alias("d"), safe(1 + t / state["c"]).alias("c")))
        return _let(turned, lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (state["h"] * t["c"] * t["d"]).alias("h")))

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = _let(first, lambda f: F.struct(F.lit(1.0).alias("c"), f.alias("d"), f.alias("h")))
    return F.aggregate(F.sequence(F.lit(2), F.lit(TERMS)), start, step, lambda s: s["h"])


def incomplete_beta(x, a, b) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    x, a, b = _c(x), _c(a), _c(b)
    # the fraction converges on one side; the other follows from I_x(a, b) = 1 - I_1-x(b, a)
    low = x < (a + 1) / (a + b + 2)
    turned = F.when(low, F.struct(x.alias("x"), a.alias("a"), b.alias("b"))).otherwise(F.struct((1 - x).alias("x"), b.alias("a"), a.alias("b")))

    def side(t: Column) -> Column:
        front = F.exp(log_gamma(t["a"] + t["b"]) - log_gamma(t["a"]) - log_gamma(t["b"]) + t["a"] * F.log(t["x"]) + t["b"] * F.log(1 - t["x"]))
        return front * _fraction(t["x"], t["a"], t["b"]) / t["a"]

    part = _let(turned, side)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(_let(part, lambda p: F.when(low, p).otherwise(1 - p)))


def f_upper_tail(f, df1, df2) -> Column:
    """P(F > f) of the F distribution; exact to relative precision in the far tail."""
    f, df1, df2 = _c(f), _c(df1), _c(df2)
    return F.when(f.isNotNull(), incomplete_beta(df2 / (df2 + df1 * f), df2 / 2, df1 / 2))


def f_quantile(p: float, df1, df2) -> Column:
    """The value that F stays below with probability ``p``: x = df1 f / (df2 + df1 f)
    by halving its interval, then by Newton's steps that stay inside it."""
    df1, df2 = _c(df1), _c(df2)
    a, b = df1 / 2, df2 / 2

    def step(state: Column, k: Column) -> Column:
        x = state["x"]
        slope = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + (a - 1) * F.log(x) + (b - 1) * F.log(1 - x))

        def narrowed(off: Column) -> Column:
            return F.struct(F.when(off < 0, x).otherwise(state["low"]).alias("low"), F.when(off < 0, state["high"]).otherwise(x).alias("high"),
                            (x - off / slope).alias("newton"))

        def chosen(n: Column) -> Column:
            inside = (k > HALVINGS) & (n["newton"] > n["low"]) & (n["newton"] < n["high"])
            return F.struct(n["low"].alias("low"), n["high"].alias("high"),
                            F.when(inside, n["newton"]).otherwise((n["low"] + n["high"]) / 2).alias("x"))
        return _let(_let(incomplete_beta(x, a, b) - p, narrowed), chosen)

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0.5).alias("x"))
    x = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS + STEPS)), start, step, lambda s: s["x"])
    return df2 * x / (df1 * (1 - x))
