"""Samples and partitions whose draws are hashes: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ranking import gapless_rank


def _alone(rows: DataFrame, identity: list[str], seed: int) -> DataFrame:
    return gapless_rank(rows.withColumn("_k", F.lit(0)), ["_k"], [*[F.col(c) for c in identity], F.lit(seed)], "_r").drop("_k")


def sample(rows: DataFrame, k: int, identity: list[str], seed: int = 0) -> DataFrame:
    """``k`` rows without replacement."""
    return _alone(rows, identity, seed).where(F.col("_r") < k).drop("_r")


def sample_with_replacement(rows: DataFrame, k: int, identity: list[str], seed: int = 0) -> DataFrame:
    """``k`` draws; a row drawn several times comes that often, told apart by ``draw``."""
    ranked = _alone(rows, identity, seed)
    n = F.broadcast(rows.agg(F.count("*").alias("_n")))
    draws = rows.sparkSession.range(k).select(F.col("id").alias("draw")).join(n).where("_n > 0").select("draw", F.pmod(F.xxhash64("draw", F.lit(seed)), F.col("_n")).alias("_r"))
    return draws.join(ranked, "_r").drop("_r")


def partition(rows: DataFrame, shares: list[float], identity: list[str], seed: int = 0) -> DataFrame:
    """Add ``part``: rows in random order, cut at the cumulative shares of their number."""
    ranked = _alone(rows, identity, seed).join(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    total, upto, part = sum(shares), 0.0, F.lit(len(shares) - 1)
    bounds: list[Column] = []
    for share in shares[:-1]:
        upto += share / total
        bounds.append(F.floor(F.lit(upto) * F.col("_n") + 1e-9))
    for i in range(len(bounds) - 1, -1, -1):
        part = F.when(F.col("_r") < bounds[i], i).otherwise(part)
    return ranked.withColumn("part", part).drop("_r", "_n")


def out_of_bag(rows: DataFrame, bag: DataFrame, identity: list[str]) -> DataFrame:
    return rows.join(bag.select(*identity).distinct(), identity, "left_anti")


def zscore(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Standardise columns by their sample deviation; one under 1e-8 counts as 1."""
    told = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    sd = lambda c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) < 1e-8, 1.0).otherwise(F.col(f"_s_{c}"))
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / sd(c) for c in columns}
    return rows.join(F.broadcast(told)).select(*[z[c].alias(c) if c in z else F.col(c) for c in rows.columns])
