"""Statistics for which there is no built-in."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out, k = 1.0, 0.0, 1.0, 0
    while k < 400:
        m = k // 2
        if k == 0:
            step = 1.0
        elif k % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + step * d, 1e-300, key=abs)
        c = max(1 + step / c, 1e-300, key=abs)
        out *= c * d
        if k > 1 and abs(c * d - 1) < 1e-14:
            break
        k += 1
    return front * (out - 1)


def pearson_p(r: float, n: int) -> float | None:
    """The two-sided p-value of a correlation of n pairs; null below three pairs."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return incomplete_beta(df / 2, 0.5, df / (df + r * r * df / (1 - r * r)))


@F.pandas_udf(T.DoubleType())
def pearson_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([pearson_p(a, None if pd.isna(b) else int(b)) if not pd.isna(a) else None for a, b in zip(r, n, strict=True)], dtype="float64")


def lcs_length(a: list, b: list) -> int:
    """The length of the longest common subsequence, in memory linear in the shorter one."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """The F-measure of the longest common subsequence of lower-case words."""

    def score(c, r):
        if c is None or r is None:
            return None
        a, b = c.lower().split(), r.lower().split()
        n = lcs_length(a, b)
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([score(c, r) for c, r in zip(candidate, reference, strict=True)], dtype="float64")
