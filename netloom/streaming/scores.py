"""Streaming forms of the score tables, as an extension: the same column expressions on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scores(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """``window, id, n, mean, top`` of ``ts, id, score`` rows, rows later than ``late`` dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("top"))


def latest_edges(rows: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Last weight of each pair in each window of ``ts, src, dst, weight`` rows, by the rules of the edge loader."""
    w = F.abs(F.expr("try_cast(weight AS DOUBLE)"))
    pair = rows.withWatermark("ts", late).where(w.isNotNull()).select("ts", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("w")).where("src <> dst")
    return pair.groupBy(F.window("ts", width), "src", "dst").agg(F.max_by("w", F.struct("ts", "w")).alias("w"))
