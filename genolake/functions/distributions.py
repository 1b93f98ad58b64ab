"""Distribution functions: the normal quantile as an expression, t, F and Beta tails as vectorised functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Coefficients of a published rational approximation of the normal quantile (relative error about 1e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out.replace("e+", "E").replace("e-", "E-")


def normal_quantile_sql(p: str) -> str:
    """SQL text, the same for both engines."""
    q, tail = f"sqrt(-2E0 * ln({p}))", f"sqrt(-2E0 * ln(1E0 - {p}))"
    middle, r = f"({p} - 0.5E0)", f"(({p} - 0.5E0) * ({p} - 0.5E0))"
    one = "(" + _horner("{x}", _D) + " * {x} + 1E0)"
    low = f"{_horner(q, _C)} / {one.format(x=q)}"
    high = f"-{_horner(tail, _C)} / {one.format(x=tail)}"
    mid = f"{_horner(r, _A)} * {middle} / ({_horner(r, _B)} * {r} + 1E0)"
    return f"CASE WHEN {p} <= 0E0 OR {p} >= 1E0 THEN NULL WHEN {p} < 0.02425E0 THEN {low} WHEN {p} > 0.97575E0 THEN {high} ELSE {mid} END"


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function of arrays, by its continued fraction."""
    import math

    import numpy as np

    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1, 1.0, 0.0)
    ok = (x > 0) & (x < 1)
    if not ok.any():
        return out
    a, b, x = a[ok], b[ok], x[ok]
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(abs(d * c - 1) < 1e-14):
            break
    value = front * h
    out[ok] = np.where(swap, 1 - value, value)
    return out


def t_two_sided(t, df):
    """P(|T| >= |t|)."""
    import numpy as np

    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f, df1, df2):
    """P(F >= f)."""
    import numpy as np

    f = np.asarray(f, float)
    return incomplete_beta(np.asarray(df2, float) / 2, np.asarray(df1, float) / 2, df2 / (df2 + df1 * f))


def t_pvalue(t: Column, df: Column) -> Column:
    @pandas_udf("double")
    def run(ts, dfs):
        import pandas as pd

        return pd.Series(t_two_sided(ts.to_numpy(float), dfs.to_numpy(float)))

    return run(t.cast("double"), df.cast("double"))


def smallest_of(p: Column, n: Column) -> Column:
    """P(the smallest of n uniform values <= p): the Beta(1, n) distribution function."""
    return -F.expm1(n * F.log1p(-p))


def incomplete_gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by its series below the mean and its continued fraction above."""
    import math

    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        b += 2
        num = -i * (i - a)
        d, c = 1 / (num * d + b), b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_upper(x: float, df: float) -> float:
    """P(chi-square with ``df`` degrees of freedom >= x)."""
    return incomplete_gamma_upper(df / 2, x / 2)


# Shape, scale and shift of the gamma distribution that approximates the Tracy-Widom law of order 1 (published; within about 0.001).
TRACY_WIDOM_GAMMA = (46.446, 0.186054, 9.84801)


def tracy_widom_upper(x: float) -> float:
    """P(Tracy-Widom variable of order 1 >= x)."""
    shape, scale, shift = TRACY_WIDOM_GAMMA
    return incomplete_gamma_upper(shape, (x + shift) / scale)
