"""Tail enrichment of combined gene and variant scores in cases against controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.stats import fisher, hazen
from netloom.plans.session import cut, discard

#: Score of a variant whose gene or own score is missing, in log mode.
MISSING_LOG = -999999.0
LEAST_CUTOFF = 1e-16


def gene_of(variant: Column) -> Column:
    """The text before the first ``_``; all of it where there is none."""
    return F.substring_index(variant, "_", 1)


def last_score(rows: DataFrame) -> DataFrame:
    """``id, score``: the last score of an id by ``line``, the largest if there is no ``line``."""
    order = "line" if "line" in rows.columns else "score"
    return rows.groupBy("id").agg(F.max_by("score", F.struct(order, "score")).alias("score"))


def cut_low(scores: DataFrame, cutoff: float, log: bool = False) -> DataFrame:
    """Scores under ``cutoff`` become 0, or the missing score in log mode; rows stay."""
    return scores.withColumn("score", F.when(F.col("score") < cutoff, MISSING_LOG if log else 0.0).otherwise(F.col("score")))


def set_score(scores: DataFrame, ids: DataFrame, value: float) -> DataFrame:
    """Listed ids that have a score get ``value``."""
    listed = ids.select("id").distinct().withColumn("_in", F.lit(True))
    return scores.join(listed, "id", "left").withColumn("score", F.when(F.col("_in"), F.lit(value)).otherwise(F.col("score"))).drop("_in")


def mild(scores: DataFrame, ids: DataFrame, log: bool = False) -> DataFrame:
    return set_score(scores, ids, MISSING_LOG if log else 0.0)


def enforce(scores: DataFrame, ids: DataFrame, log: bool = False) -> DataFrame:
    return set_score(scores, ids, 0.0 if log else 1.0)


def combine(variants: DataFrame, variant_scores: DataFrame, gene_scores: DataFrame, excluded: DataFrame | None = None, log: bool = False, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """``keys, id, score`` of the different variants of each group.

    The score is variant score times gene score, or their sum in log mode; 0 or
    the missing score where one of them is absent.  Variants of excluded genes
    are dropped.
    """
    own = variants.select(*keys, "id").distinct().withColumn("_gene", gene_of(F.col("id")))
    if excluded is not None:
        own = own.join(excluded.select(F.col("id").alias("_gene")).distinct(), "_gene", "left_anti")
    v = variant_scores.select("id", F.col("score").alias("_v"))
    g = gene_scores.select(F.col("id").alias("_gene"), F.col("score").alias("_g"))
    both = F.col("_v") + F.col("_g") if log else F.col("_v") * F.col("_g")
    joined = own.join(v, "id", "left").join(g, "_gene", "left")
    return joined.select(*keys, "id", F.coalesce(both, F.lit(MISSING_LOG if log else 0.0)).alias("score"))


def cutoff(scores: DataFrame, q: float = 0.95, log: bool = False, keys: list[str] | None = None) -> DataFrame:
    """``keys, cutoff``: Hazen quantile of the control scores, at least 1e-16 outside log mode; no row without controls."""
    found = hazen(scores.where("grp = 'control'"), "score", [q], keys)
    value = F.col("q") if log else F.greatest("q", F.lit(LEAST_CUTOFF))
    return found.select(*(keys or []), value.alias("cutoff"))


def contingency(scores: DataFrame, cut: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, a, b, c, d``: controls under and from the cutoff, cases under and from it."""
    keys = keys or []
    joined = scores.join(cut, keys) if keys else scores.join(F.broadcast(cut))
    hit = F.col("score") >= F.col("cutoff")
    n = lambda grp, yes: F.sum(((F.col("grp") == grp) & (hit if yes else ~hit)).cast("long"))
    return joined.groupBy(*keys).agg(n("control", False).alias("a"), n("control", True).alias("b"), n("case", False).alias("c"), n("case", True).alias("d"))


def statistics(table: DataFrame) -> DataFrame:
    """Add ``p`` (right-tailed exact test), likelihood ratio ``lr`` and diagnostic odds ratio ``dor``."""
    tested = fisher(table, "right", name="p")
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    lr = F.try_divide(F.try_divide(d, d + c), F.try_divide(b, b + a))
    return tested.withColumn("lr", lr).withColumn("dor", F.try_divide(d * a, b * c))


def tail_scores(scores: DataFrame) -> DataFrame:
    """``id, score, flag`` with flag ``c`` for cases and ``t`` for controls."""
    return scores.select("id", "score", F.when(F.col("grp") == "case", "c").otherwise("t").alias("flag"))


def in_tail(scores: DataFrame, cut: DataFrame) -> DataFrame:
    return scores.join(F.broadcast(cut)).where("score >= cutoff").drop("cutoff")


def pool(variants: DataFrame) -> DataFrame:
    """``id, grp, n``: the different ids, how many entries each has, and its group; an id that is in both groups counts as control."""
    return variants.groupBy("id").agg(F.when(F.max((F.col("grp") == "control").cast("int")) == 1, "control").otherwise("case").alias("grp"), F.count("*").alias("n"))


def _comes_up(seed: int) -> Column:
    """Whether the id comes up in the replicate ``rep``, with a chance of ``_p``."""
    return (F.shiftrightunsigned(F.xxhash64("id", "rep", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53) < F.col("_p")


def _drawn(entries: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``rep`` and the columns of ``entries`` (``id, n`` and others) for each replicate that an id comes up in."""
    chance = entries.withColumn("_p", 1 - F.exp(-F.col("n").cast("double")))
    return chance.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).where(_comes_up(seed)).drop("_p")


def bootstrap(variants: DataFrame, replicates: int = 100, seed: int = 0) -> DataFrame:
    """``rep, id, grp``: for each replicate the different ids among as many draws as the pool has entries.

    The pool is all case and control entries; an id that is in both groups
    counts as control.  Each entry draws for itself: how often it comes up in a
    replicate is Poisson with mean 1, the limit of drawing with replacement, so
    nothing has to be numbered or joined, and only whether it comes up at all
    matters as ids are de-duplicated.
    """
    return _drawn(pool(variants), replicates, seed).select("rep", "id", "grp")


def bootstrap_tables(scores: DataFrame, replicates: int = 100, seed: int = 0, q: float = 0.95, log: bool = False) -> DataFrame:
    """``rep, a, b, c, d``: what ``contingency`` counts in each replicate of ``bootstrap``, from its own ``cutoff``.

    ``scores`` has ``id, grp, n, score``, what ``combine`` makes of ``pool``: a
    score does not depend on the replicate.  The pool lies in ranges of the
    score, the same for all replicates; how many controls each draws from a
    range tells in which range its quantile lies, and only that is ranked.  So
    draws are made where the pool lies, and none is shuffled.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written first, as finding the ranges reads the rows once more
    told = cut(scores.select("id", "grp", "n", "score"))
    dealt = cut(told.repartitionByRange(parts, F.col("score"), F.xxhash64("id")).withColumn("_part", F.spark_partition_id()))
    control = dealt.where("grp = 'control'")
    counted = cut(_drawn(control.select("id", "n", "_part"), replicates, seed).groupBy("rep", "_part").agg(F.count("*").alias("_c")))
    over = Window.partitionBy("rep")
    first = F.coalesce(F.sum("_c").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counted.select("rep", "_part", "_c", first.alias("_first"), F.sum("_c").over(over).alias("_n"))
    h = F.greatest(F.lit(0.0), F.least((F.col("_n") - 1).cast("double"), F.lit(float(q)) * F.col("_n") - 0.5))
    spans = spans.withColumns({"_h": h, "_low": F.floor(h), "_high": F.ceil(h)})
    holds = lambda rank, first, upto: (F.col(rank) >= first) & (F.col(rank) < upto)
    ends = (F.col("_first"), F.col("_first") + F.col("_c"))
    wanted = F.broadcast(cut(spans.where(holds("_low", *ends) | holds("_high", *ends)).drop("_c", "_n")))

    # two rows of wanted for a replicate at most, and most replicates want the same ranges
    near = control.join(wanted.select("_part").distinct(), "_part", "left_semi").repartition("id").withColumn("_p", 1 - F.exp(-F.col("n").cast("double")))
    value = near.join(wanted, "_part").where(_comes_up(seed)).groupBy("rep", "_part", "_first", "_h", "_low", "_high", "score").agg(F.count("*").alias("_c"))
    upto = F.col("_first") + F.sum("_c").over(Window.partitionBy("rep", "_part").orderBy("score"))
    value = value.withColumn("_upto", upto)
    of = lambda rank: F.max(F.when(holds(rank, F.col("_upto") - F.col("_c"), F.col("_upto")), F.col("score")))
    found = value.groupBy("rep").agg(of("_low").alias("_a"), of("_high").alias("_b"), F.max(F.col("_h") - F.col("_low")).alias("_f"))
    quantile = F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))
    cutoffs = cut(found.select("rep", (quantile if log else F.greatest(quantile, F.lit(LEAST_CUTOFF))).alias("cutoff")))
    tables = cut(contingency(_drawn(dealt, replicates, seed), F.broadcast(cutoffs), ["rep"]))
    discard(told, dealt, counted, cutoffs)
    return tables
