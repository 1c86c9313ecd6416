"""Quantiles and hypothesis tests as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.session import cut


def hazen(values: DataFrame, column: str, probabilities: list[float], keys: list[str] | None = None) -> DataFrame:
    """Hazen quantiles, ``keys, p, q``: positions (k + 1/2) / n, linear between, clamped at the ends.

    Values are counted first; the running counts of different values tell which
    value has which rank, so equal values never travel one by one.  Nulls do
    not count; a key without values has no row.
    """
    keys = keys or []
    counted = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = running(counted, "_v", ["_c"], keys=keys).withColumnRenamed("_c_upto", "_hi")
    total = F.broadcast(counted.agg(F.sum("_c").alias("_n"))) if not keys else counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = ranked.join(total, keys) if keys else ranked.join(total)
    asked = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    h = F.greatest(F.lit(0.0), F.least((F.col("_n") - 1).cast("double"), F.col("p") * F.col("_n") - 0.5))
    low, high = F.floor(h), F.ceil(h)
    first = F.col("_hi") - F.col("_c")
    holds = lambda rank: (rank >= first) & (rank < F.col("_hi"))
    found = asked.where(holds(low) | holds(high)).groupBy(*keys, "p").agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"), F.max(h - low).alias("_f")
    )
    return found.select(*keys, "p", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("q"))


def running(rows: DataFrame, order: str, columns: list[str], descending: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Add ``<column>_upto``: running sums within ``keys``, or over all rows, in the order of a column that is unique there.

    Rows are dealt into ranges of keys and order; each range is summed on its
    own and starts from its key's totals in the ranges before it, so no task
    sees all rows of a key.  Keys that are null have no running sums.
    """
    keys = keys or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.desc(order) if descending else F.asc(order)
    known = rows.na.drop(subset=keys) if keys else rows
    dealt = cut(known.repartitionByRange(parts, *keys, by).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    totals = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(columns))])
    inside = Window.partitionBy(*keys, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[F.sum(c).over(inside).alias(f"_l{i}") for i, c in enumerate(columns)])
    return local.join(totals, [*keys, "_part"]).select(*rows.columns, *[(F.col(f"_l{i}") + F.col(f"_b{i}")).alias(f"{c}_upto") for i, c in enumerate(columns)])


TAILS = ("left", "right", "both")


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula for it: exact for small n, the first terms of the series beyond."""
    small = np.array([math.lgamma(k + 1) - ((k + 0.5) * math.log(k) - k + 0.5 * math.log(2 * math.pi)) if k else 0.0 for k in range(16)])
    x = np.maximum(n, 16)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return np.where(n < 16, small[np.minimum(n, 15).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    with np.errstate(divide="ignore", invalid="ignore"):
        v = (x - mean) / (x + mean)
        out, term = (x - mean) * v, 2 * x * v
        for j in range(1, 12):
            term = term * v * v
            out = out + term / (2 * j + 1)
        far = x * np.log(np.where(x > 0, x, 1) / mean) + mean - x
    return np.where(np.abs(x - mean) < 0.1 * (x + mean), out, np.where(x > 0, far, mean))


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log of the binomial probability of ``x``, by its saddle point."""
    q = 1 - p
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * np.log(n / (2 * math.pi * np.where((x > 0) & (x < n), x * (n - x), 1)))
        edge = np.where(x == 0, n * np.log1p(-p), n * np.log(np.where(p > 0, p, 1)))
    return np.where((x > 0) & (x < n), inner, np.where(n > 0, edge, 0.0))


def _log_hypergeometric(a: np.ndarray, ab: np.ndarray, cd: np.ndarray, ac: np.ndarray) -> np.ndarray:
    p = np.where(ab + cd > 0, ac / np.maximum(ab + cd, 1), 0.0)
    return _log_binomial(a, ab, p) + _log_binomial(ac - a, cd, p) - _log_binomial(ac, ab + cd, p)


def _tail_sum(a: float, ab: float, cd: float, ac: float, up: bool) -> float:
    """The sum of the probabilities from ``a`` on outwards, relative to that of ``a``, until terms no longer count."""
    total, term, at = 1.0, 1.0, a
    while True:
        steps = at + np.arange(0, 4096) * (1 if up else -1)
        if up:
            ratio = (ab - steps) * (ac - steps) / ((steps + 1) * (cd - ac + steps + 1))
        else:
            ratio = steps * (cd - ac + steps) / ((ab - steps + 1) * (ac - steps + 1))
        terms = term * np.cumprod(np.maximum(ratio, 0.0))
        total += terms.sum()
        term, at = terms[-1], steps[-1] + (1 if up else -1)
        if term <= total * 1e-17:
            return total


def exact_p(a: float, b: float, c: float, d: float, tail: str) -> float:
    """p-value of one 2 x 2 table; sums run outwards from the observed cell, away from the mode, so small ones are exact too."""
    ab, cd, ac = a + b, c + d, a + c
    mode = math.floor((ab + 1) * (ac + 1) / (ab + cd + 2))
    log_p = lambda k: float(_log_hypergeometric(*(np.array([float(v)]) for v in (k, ab, cd, ac)))[0])
    own = log_p(a)
    side = lambda k, up: math.exp(min(0.0, log_p(k) + math.log(_tail_sum(k, ab, cd, ac, up))))
    low, high = max(0.0, ac - cd), min(ab, ac)
    if tail != "both":
        up = tail == "right"
        if (a >= mode) == up or a == mode:
            return side(a, up)
        other = a - 1 if up else a + 1
        return 1.0 - side(other, not up) if low <= other <= high else 1.0
    if a == mode:
        return 1.0
    up = a > mode
    # the first cell on the other side of the mode that is not likelier
    near, far = (mode, low) if up else (mode, high)
    most = own + 1e-7
    if log_p(far) > most:
        return min(1.0, side(a, up))
    while abs(near - far) > 1:
        middle = float((near + far) // 2)
        near, far = (near, middle) if log_p(middle) <= most else (middle, far)
    edge = near if log_p(near) <= most else far
    return min(1.0, side(a, up) + side(edge, not up))


def fisher(tables: DataFrame, tail: str = "right", cells: tuple[str, str, str, str] = ("a", "b", "c", "d"), name: str = "p") -> DataFrame:
    """Add the exact test's p-value of 2 x 2 tables.

    ``left`` sums the hypergeometric probabilities up to ``a``, ``right`` from
    ``a``, ``both`` all that are not above that of ``a``, but for a share of
    1e-7.  Each row is summed from its own cell outwards; only terms that count
    are formed, so the work grows with the spread of the distribution and not
    with the cells.  A null cell gives null.
    """
    if tail not in TAILS:
        raise ValueError(f"tail is one of {TAILS}")

    @F.pandas_udf("double")
    def tested(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        rows = zip(a, b, c, d, strict=True)
        return pd.Series([None if any(pd.isna(v) for v in row) else exact_p(*map(float, row), tail) for row in rows], dtype="float64")

    return tables.withColumn(name, tested(*[F.col(x).cast("long") for x in cells]))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


#: Degrees of freedom from which a value of t is turned into one of the normal law, by a series in their inverse square.
MANY = 1e5


def _normal_value(t: float, df: float) -> float:
    """The value of the normal law with the tail that ``t`` has (Hill's expansion); what it leaves out is of the order of ``df ** -6``."""
    a = df - 0.5
    b = 48 * a * a
    z = math.sqrt(a * math.log1p(t * t / df))
    return z + (z**3 + 3 * z) / b - (4 * z**7 + 33 * z**5 + 240 * z**3 + 855 * z) / (10 * b * (b + 0.8 * z**4 + 100))


def student_tail(t: float, df: float) -> float:
    """Probability of a value above ``abs(t)`` of Student's t, worked out from that tail, so small ones keep their digits."""
    if not (df > 0) or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    if t == 0:
        return 0.5
    if df >= MANY:
        return math.erfc(_normal_value(t, df) / math.sqrt(2)) / 2
    square = t * t
    x, rest, a, b = df / (df + square), square / (df + square), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - a * math.log1p(square / df) + b * math.log(rest))
    whole = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, rest) / b
    return whole / 2


def student_p(t: float, df: float, tail: str = "both") -> float:
    """p-value of ``t``: the probability of a value under it, above it, or further from 0 than it."""
    beyond = student_tail(t, df)
    if tail == "both":
        return 2 * beyond
    return beyond if (t > 0) == (tail == "right") else 1 - beyond


def with_p_value(rows: DataFrame, tail: str = "both") -> DataFrame:
    """Add ``p`` to rows with ``t`` and ``df``; a null, or no degree of freedom, gives null."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_p(x, d, tail) if pd.notna(x) and pd.notna(d) else math.nan for x, d in zip(t, df, strict=True)], dtype="float64")

    if tail not in TAILS:
        raise ValueError(f"tail is one of {TAILS}")
    return rows.withColumn("p", p(F.col("t").cast("double"), F.col("df").cast("double")))


def t_one(mean: Column, sd: Column, n: Column) -> tuple[Column, Column]:
    """t and degrees of freedom of a mean against 0."""
    return F.try_divide(mean, sd / F.sqrt(n.cast("double"))), (n - 1).cast("double")


def t_pooled(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column]:
    """Two means with one variance; with a single item on one side, the other side's mean less it against 0."""
    df = (n1 + n2 - 2).cast("double")
    pooled = F.sqrt(F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, df))
    two = F.try_divide(m1 - m2, pooled * F.sqrt(F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    one, other = t_one(m2 - m1, s2, n2)[0], t_one(m1 - m2, s1, n1)[0]
    return F.when(n1 <= 1, one).when(n2 <= 1, other).otherwise(two), F.when(n1 <= 1, (n2 - 1).cast("double")).when(n2 <= 1, (n1 - 1).cast("double")).otherwise(df)


def t_welch(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column]:
    """Two means with variances of their own."""
    v1, v2 = F.try_divide(s1 * s1, n1), F.try_divide(s2 * s2, n2)
    df = F.try_divide((v1 + v2) * (v1 + v2), F.try_divide(v1 * v1, n1 - 1) + F.try_divide(v2 * v2, n2 - 1))
    return F.try_divide(m1 - m2, F.sqrt(v1 + v2)), df
