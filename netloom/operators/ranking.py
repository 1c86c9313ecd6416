"""Gapless ranks inside groups of any size, in any order or in a given one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.session import cut, discard

#: Ranges of the order hash that a group is dealt into.
RANGES = 256


def gapless_rank(df: DataFrame, keys: list[str], identity: list[Column], name: str = "rank", ranges: int = RANGES) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each value of ``keys``.

    A plain window would sort a whole group in one task.  Here each group is
    dealt into ``ranges`` ranges of a hash of ``identity``: counts per range are
    summed first (map-side combined, ``groups x ranges`` rows), their running
    sums give each range's first rank, and only one range is sorted at a time.
    The order is that of the hash, so it is stable when tasks are run again.
    Rows that are equal in ``identity`` and ``keys`` get ranks next to each
    other in any order; ``identity`` may hold nulls, ``keys`` may not.
    Counts, local ranks and their join are dealt by the same columns, so rows
    are shuffled once.
    """
    ordered = df.withColumn("_order", F.xxhash64(*identity)).withColumn("_range", F.pmod(F.col("_order"), F.lit(ranges)).cast("int"))
    firsts = (
        ordered.groupBy(*keys, "_range")
        .count()
        .withColumn("_first", F.sum("count").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "_range", F.coalesce("_first", F.lit(0)).alias("_first"))
    )
    local = ordered.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_order", *identity)))
    return local.join(firsts, [*keys, "_range"]).withColumn(name, (F.col("_first") + F.col("_local") - 1).cast("long")).select(*df.columns, name)


def ordered_rank(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, 0, 1, .. within each ``key`` in the order given, and ``total``, the rows of the key; written down.

    Ranges of key and order are sorted on their own and start where the ranges
    before them end, so no task sees all rows of a key.  Rows that are equal in
    key and order may be split anywhere and are numbered by chance.  ``key``
    may not be null; nulls of ``order`` come first.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written first, as finding the ranges reads the rows once more
    told = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    by = [key, *order, "_row"]
    dealt = cut(told.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).alias("_part")
    spans = dealt.groupBy(key, part).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(key, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(key)).alias("total"))
    out = cut(dealt.withColumn("_part", part).join(spans, [key, "_part"]).withColumn("at", F.col("_base") + F.col("_row") - F.col("_first")).select(*rows.columns, "at", "total"))
    discard(told, dealt)
    return out
