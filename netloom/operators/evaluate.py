"""Curves and summary measures of scored predictions against labels.

Items are summed by different score first; curves are running sums over those
rows, in ranges, so no task needs all items.  ``keys`` make one curve per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import rates
from netloom.functions.stats import hazen, running
from netloom.operators.ranking import ordered_rank


def confusion(rows: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``keys, tau, tp, fp, tn, fn`` for every different score: items with ``score >= tau`` count as predicted."""
    keys = keys or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    by = rows.where("score is not null and label is not null").groupBy(*keys, F.col("score").alias("tau")).agg(F.sum(F.when(F.col("label"), w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("label"), 0.0).otherwise(w)).alias("n"))
    told = running(by, "tau", ["p", "n"], descending=True, keys=keys).withColumnsRenamed({"p_upto": "tp", "n_upto": "fp"})
    whole = by.groupBy(*keys).agg(F.sum("p").alias("_P"), F.sum("n").alias("_N"))
    told = told.join(whole, keys) if keys else told.join(F.broadcast(whole))
    return told.select(*keys, "tau", "tp", "fp", (F.col("_N") - F.col("fp")).alias("tn"), (F.col("_P") - F.col("tp")).alias("fn"))


#: Most thresholds that confusion_at takes.
MOST_TAUS = 1024


def _reached(score: Column, taus: list[float], first: int = 0, last: int | None = None) -> Column:
    """How many of the ordered thresholds a score reaches, by halving."""
    last = len(taus) if last is None else last
    if first == last:
        return F.lit(first)
    middle = (first + last) // 2
    return F.when(score >= F.lit(taus[middle]), _reached(score, taus, middle + 1, last)).otherwise(_reached(score, taus, first, middle))


def confusion_at(rows: DataFrame, taus: DataFrame, weight: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Confusion counts at the thresholds of a small table ``tau``, of MOST_TAUS at most.

    Each row is put between two thresholds once; sums of the intervals are
    combined before they are shuffled, and added up from the top.
    """
    keys = keys or []
    listed = sorted(r["tau"] for r in taus.select("tau").where("tau is not null").distinct().limit(MOST_TAUS + 1).collect())
    if len(listed) > MOST_TAUS:
        raise ValueError(f"over {MOST_TAUS} thresholds; confusion() takes every different score")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    counted = rows.where("score is not null and label is not null")
    told = counted.groupBy(*keys, _reached(F.col("score"), listed).alias("i")).agg(F.sum(F.when(F.col("label"), w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("label"), 0.0).otherwise(w)).alias("n"))
    whole = told.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "p", "n"))).alias("b")).where(F.size("b") > 0)
    asked = F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(j + 1).alias("j")) for j, t in enumerate(listed)]) if listed else F.array().cast("array<struct<tau:double,j:int>>")
    at = whole.select(*keys, "b", F.explode(asked).alias("t")).select(*keys, "b", "t.tau", "t.j")
    add = lambda field, over: F.aggregate(F.filter("b", lambda x: (x["i"] >= F.col("j")) if over else (x["i"] < F.col("j"))), F.lit(0.0), lambda s, x: s + x[field])
    return at.select(*keys, "tau", add("p", True).alias("tp"), add("n", True).alias("fp"), add("n", False).alias("tn"), add("p", False).alias("fn"))


def roc(cm: DataFrame) -> DataFrame:
    """``tau, x, y`` with x = false and y = true positive rate; no point (0, 0) is added."""
    return cm.withColumn("x", rates.fpr()).withColumn("y", rates.tpr())


def prc(cm: DataFrame, compat: bool = False) -> DataFrame:
    """Recall and precision; with ``compat`` false and true positive rate, as a ROC curve has."""
    return roc(cm) if compat else cm.withColumn("x", rates.recall()).withColumn("y", rates.precision())


def rmc(cm: DataFrame) -> DataFrame:
    """Normalised remaining uncertainty and misinformation."""
    return cm.withColumn("x", rates.nru()).withColumn("y", rates.nmi())


def ordered_points(points: DataFrame, key: str | None = None) -> DataFrame:
    """``at, x, y``, and ``key`` if given: the different points of each key in the order of x, then y, numbered from 0; points with a null are none."""
    own = points.where("x is not null and y is not null").select(*([F.col(key).alias("_key")] if key else [F.lit(0).alias("_key")]), "x", "y").distinct()
    told = ordered_rank(own.where("_key is not null"), "_key", ["x", "y"])
    return told.select(*([F.col("_key").alias(key)] if key else []), "at", "x", "y")


def trapezoid(points: DataFrame, keys: list[str] | None = None, name: str = "auc", start: bool = False) -> DataFrame:
    """Area under different points ordered by x, then y; 0 if there are fewer than two.

    ``start`` adds the point (0, 0).  Points are dealt into ranges of keys and
    place; each range is added up on its own, and neighbouring ranges of a key
    are joined by their end points.
    """
    keys = keys or []
    own = points.where("x is not null and y is not null").select(*keys, "x", "y").distinct()
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(parts, *keys, "x", "y").withColumn("_p", F.spark_partition_id())
    over = Window.partitionBy(*keys, "_p").orderBy("x", "y")
    area = (F.col("y") + F.lag("y").over(over)) * (F.col("x") - F.lag("x").over(over)) / 2
    inner = dealt.select(*keys, "_p", "x", "y", F.coalesce(area, F.lit(0.0)).alias("_a"))
    edge = F.struct("x", "y")
    ranges = inner.groupBy(*keys, "_p").agg(F.sum("_a").alias("_a"), F.min(edge).alias("lo"), F.max(edge).alias("hi"))
    join = Window.partitionBy(*keys).orderBy("_p")
    gap = (F.col("lo.y") + F.lag("hi.y").over(join)) * (F.col("lo.x") - F.lag("hi.x").over(join)) / 2
    first = F.when(F.row_number().over(join) == 1, F.col("lo.x") * F.col("lo.y") / 2).otherwise(0.0) if start else F.lit(0.0)
    area = ranges.select(*keys, (F.col("_a") + F.coalesce(gap, F.lit(0.0)) + first).alias("_a"))
    return area.groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias(name))


def auc(rows: DataFrame, keys: list[str] | None = None, standard: bool = False) -> DataFrame:
    """Area under the ROC points of the different scores; ``standard`` starts the curve at (0, 0)."""
    return trapezoid(roc(confusion(rows, keys)), keys, start=standard)


def fmax(points: DataFrame, beta: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Largest F measure of points x = recall, y = precision."""
    return points.groupBy(*(keys or [])).agg(F.max(rates.f_measure(beta)).alias("fmax"))


def sdmin(cm: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Smallest distance of (remaining uncertainty, misinformation) from the origin."""
    x, y = rates.ru(), rates.mi()
    return cm.groupBy(*(keys or [])).agg(F.sqrt(F.min(x * x + y * y)).alias("sdmin"))


METRICS = ("auc", "fmax", "sdmin")


def macro_average(panel: DataFrame, by: str, metric: str = "auc", weight: str | None = None) -> DataFrame:
    """``metric, n_used, n_skipped``: mean over the values of ``by`` (rows or columns of a panel).

    A value without positives or without negatives has no rates and is counted
    as skipped.  ``sdmin`` is only meant for averages over instances.
    """
    cm = confusion(panel, [by], weight)
    if metric == "auc":
        each = trapezoid(roc(cm), [by], metric)
    elif metric == "fmax":
        each = fmax(prc(cm), keys=[by])
    elif metric == "sdmin":
        each = sdmin(cm, [by])
    else:
        raise ValueError(f"metric is one of {METRICS}")
    usable = panel.where("score is not null and label is not null").groupBy(by).agg((F.max(F.col("label").cast("int")) == 1).alias("_p"), (F.min(F.col("label").cast("int")) == 0).alias("_n"))
    joined = usable.join(each, by, "left")
    used = F.col("_p") & F.col("_n") & F.col(metric).isNotNull()
    return joined.agg(F.avg(F.when(used, F.col(metric))).alias(metric), F.sum(used.cast("long")).alias("n_used"), F.sum((~used).cast("long")).alias("n_skipped"))


def micro_thresholds(panel: DataFrame, digits: int | None = None) -> DataFrame:
    """``tau``: Hazen percentiles 0 to 100 of the positive scores, and 0 and 1.

    A percentile between two scores may miss a score that it equals by the last
    bit.  Where scores have fewer decimals, ``digits`` rounds that off.
    """
    tau = F.col("q") if digits is None else F.round("q", digits)
    q = hazen(panel.where("score > 0"), "score", [i / 100 for i in range(101)]).select(tau.alias("tau"))
    return q.union(panel.sparkSession.range(2).select(F.col("id").cast("double"))).distinct()


def micro_confusion(panel: DataFrame, weight: str | None = None, digits: int | None = None) -> DataFrame:
    """Counts summed over all rows of a panel at :func:`micro_thresholds`."""
    return confusion_at(panel, micro_thresholds(panel, digits), weight)


def micro_average(panel: DataFrame, metric: str = "auc", weight: str | None = None, digits: int | None = None) -> DataFrame:
    cm = micro_confusion(panel, weight, digits)
    if metric == "auc":
        return trapezoid(roc(cm))
    return fmax(prc(cm)) if metric == "fmax" else sdmin(cm)


def label_scores(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """``id, score, label``: every labelled row, scored 0 where there is no prediction."""
    return labels.join(predictions, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), "label")


def align(genes: DataFrame, predictions: DataFrame, positive: DataFrame | None = None, negative: DataFrame | None = None) -> DataFrame:
    """``id, score`` of every listed gene, rounded to 8 decimals; listed positives score 1, negatives 0."""
    out = genes.select("id").join(predictions, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    for ids, value in ((positive, 1.0), (negative, 0.0)):
        if ids is not None:
            listed = ids.select("id").distinct().withColumn("_in", F.lit(True))
            out = out.join(listed, "id", "left").select("id", F.when(F.col("_in"), value).otherwise(F.col("score")).alias("score"))
    return out.withColumn("score", F.round("score", 8))


def calibrate(scores: DataFrame, prior: float, c: float = 1.0, option: int = 1) -> DataFrame:
    """Posterior ``c * prior * d / (1 - d)`` of scores d in [0, 1], 1 where d is within 1e-8 of 1.

    Option 0 leaves it, 1 clamps it to [0, 1], 2 scales ``(p - min) / (3 sd)``
    and clamps, 3 takes the logarithm.
    """
    d = F.col("score")
    raw = F.when(d >= 1 - 1e-8, 1.0).otherwise(c * prior * d / F.when(d >= 1 - 1e-8, 1.0).otherwise(1 - d))
    out = scores.withColumn("score", raw)
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    if option == 1:
        return out.withColumn("score", clamp(F.col("score")))
    if option == 2:
        told = out.agg(F.min("score").alias("_m"), F.stddev_samp("score").alias("_s"))
        return out.join(F.broadcast(told)).withColumn("score", clamp(F.try_divide(F.col("score") - F.col("_m"), 3 * F.col("_s")))).drop("_m", "_s")
    if option == 3:
        return out.withColumn("score", F.when(F.col("score") > 0, F.log(F.when(F.col("score") > 0, F.col("score")))).otherwise(float("-inf")))
    return out


def auc_summary(aucs: DataFrame, keys: list[str]) -> DataFrame:
    return aucs.groupBy(*keys).agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("std"))


def p_value_summary(p: DataFrame, keys: list[str]) -> DataFrame:
    """``neglog10`` of the row with the last ``line``, and the spread over the rows before it."""
    last = p.groupBy(*keys).agg(F.max("line").alias("_last"))
    joined = p.join(last, keys)
    value = -F.log10("p")
    return joined.groupBy(*keys).agg(F.max(F.when(F.col("line") == F.col("_last"), value)).alias("neglog10"), F.stddev_samp(F.when(F.col("line") < F.col("_last"), value)).alias("std"))


def significance(n_tests: Column) -> tuple[Column, Column]:
    """-log10 of 0.05 and of the Bonferroni level 0.05 / n."""
    return -F.log10(F.lit(0.05)), -F.log10(F.lit(0.05) / n_tests)
