"""Rates of weighted confusion counts ``tp, fp, tn, fn``; null where there is nothing to divide by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TP, FP, TN, FN = "tp", "fp", "tn", "fn"


def _of(c: str) -> Column:
    return F.col(c).cast("double")


def precision() -> Column:
    return F.try_divide(_of(TP), _of(TP) + _of(FP))


def recall() -> Column:
    return F.try_divide(_of(TP), _of(TP) + _of(FN))


tpr = sensitivity = recall


def specificity() -> Column:
    return F.try_divide(_of(TN), _of(TN) + _of(FP))


def fpr() -> Column:
    return F.try_divide(_of(FP), _of(TN) + _of(FP))


def ru() -> Column:
    """Remaining uncertainty: the weight that was missed."""
    return _of(FN)


def mi() -> Column:
    """Misinformation: the weight that was predicted wrongly."""
    return _of(FP)


def nru() -> Column:
    """Remaining uncertainty over all weight involved."""
    return F.try_divide(_of(FN), _of(TP) + _of(FP) + _of(FN))


def nmi() -> Column:
    return F.try_divide(_of(FP), _of(TP) + _of(FP) + _of(FN))


def f_measure(beta: float = 1.0) -> Column:
    """From columns ``x`` (recall) and ``y`` (precision)."""
    b = beta * beta
    return F.try_divide((1 + b) * F.col("x") * F.col("y"), b * F.col("y") + F.col("x"))
