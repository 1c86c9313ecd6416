"""Quality scores: ridge regression on random Fourier features of document statistics.

Cosines of random projections approximate a Gaussian kernel.  The normal
equations are summed within each partition and then over partitions, so the
driver sees one small matrix; isotonic regression over a fixed number of score
bins turns raw scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.textops import Block, blocks, sliced
from netloom.plans.session import cut

STATISTICS = (
    "log_words", "log_chars", "log_lines", "word_length", "word_length_sd", "line_words", "symbol_share", "pipe_share", "exclaim_share",
    "upper_share", "digit_share", "comma_stop_share", "wide_share", "short_words", "distinct_words", "repeated_words", "repeated_lines", "byte_entropy",
)
#: Random features, kernel width in standard deviations, ridge penalty per row, bins of raw scores.
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-3, 400
#: Raw scores are binned over this range; those beyond fall into the end bins.
LOW, HIGH = -0.5, 1.5
ACCEPT = 0.3
#: Tasks that add up the partitions' sums.
ADDERS = 16


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text; all zero where a share has nothing to divide by."""
    b = Block(texts)
    n = b.n
    byte = b.bytes
    upto = lambda mark: (c := np.concatenate(([0], np.cumsum(mark))))[b.firsts + b.sizes] - c[b.firsts]
    chars = np.maximum(upto((byte & 0xC0) != 0x80), 1)
    words = np.maximum(b.n_words, 1)
    length = b.points.astype(float)
    mean = b.per_text(length) / words
    sd = np.sqrt(np.maximum(b.per_text(length**2) / words - mean**2, 0))
    doc, _, _ = b.lines
    lines = np.bincount(doc, minlength=n)
    later = np.bincount(doc[b.later_copies()], minlength=n)
    key = np.unique(np.column_stack((b.doc.astype(np.uint64), b.words)), axis=0) if len(b.words) else np.zeros((0, 2), np.uint64)
    distinct = np.bincount(key[:, 0].astype(np.int64), minlength=n)
    histogram = np.stack([np.bincount(byte[f : f + s], minlength=256) for f, s in zip(b.firsts, b.sizes, strict=True)]) / np.maximum(b.sizes, 1)[:, None]
    entropy = -(histogram * np.log2(np.where(histogram > 0, histogram, 1))).sum(1)
    any_of = lambda marks: upto(np.isin(byte, list(marks)))
    return np.column_stack(
        (
            np.log1p(b.n_words), np.log1p(upto((byte & 0xC0) != 0x80)), np.log1p(lines), mean, sd, b.n_words / np.maximum(lines, 1),
            any_of(b"#*$%&<>") / chars, any_of(b"|") / words, any_of(b"!") / words, upto((byte >= 65) & (byte <= 90)) / chars, upto((byte >= 48) & (byte <= 57)) / chars,
            any_of(b",.") / words, upto(byte >= 0xC0) / chars, b.per_text(length <= 3) / words, distinct / words, b.per_text(b.repeated(3)) / words, later / np.maximum(lines, 1), entropy,
        )
    )


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` for every row: its statistics, from the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for first, some in blocks(texts):
                x = statistics(some)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), rows], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


class Kernel:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int = FEATURES, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.turn = draw.normal(size=(len(mean), features)) / WIDTH
        self.shift = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.column_stack((np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), np.ones(len(x))))


def _normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, int]:
    """Z'Z, Z'y and the number of rows: summed in each partition, then by a few tasks that each add some matrix rows."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                z = kernel(np.stack(frame["x"]))
                part = z.T @ np.column_stack((z, frame["y"]))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for i, row in zip(frame["i"], frame["row"], strict=True):
                sums[i] = sums[i] + row if i in sums else np.array(row)
        if sums:
            yield pd.DataFrame({"i": list(sums), "row": list(sums.values())})

    found = rows.mapInPandas(partial, "i int, row array<double>").repartition(ADDERS, "i").mapInPandas(add, "i int, row array<double>").collect()
    whole = np.array([r["row"] for r in sorted(found, key=lambda r: r["i"])])
    return whole[:, :-1], whole[:, -1], round(whole[-1, -2])


def isotonic(positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Non-decreasing rates of bins, by pooling neighbours that violate the order; empty bins take the rate before them."""
    pools: list[list[float]] = []
    for p, n in zip(positive, count, strict=True):
        pools.append([p, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    rate = np.concatenate([np.full(int(k), p / n if n else np.nan) for p, n, k in pools])
    known = np.flatnonzero(~np.isnan(rate))
    return np.interp(np.arange(len(rate)), known, rate[known]) if len(known) else np.full(len(rate), 0.5)


def _bin(raw: Column) -> Column:
    return F.least(F.greatest(F.floor((raw - LOW) * (BINS / (HIGH - LOW))), F.lit(0)), F.lit(BINS - 1)).cast("int")


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def _raw(rows: DataFrame, kernel: Kernel, weights: np.ndarray) -> DataFrame:
    names = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x"))
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(kernel(flat) @ weights)], [*names, "raw"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "x") + ", raw double"
    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id``, ``text``).

    Learns from ``labels`` (``doc_id``, ``quality``) where crc32 of the id mod 5
    is not 0; nothing but the text is an input of a score.  A null or empty text
    has zero statistics and a score like any other.  A document with several
    labels counts once per label; null labels and ids are not learned from, and
    ``held_out`` is false for a null id.  Without any label every score is 0.5.
    Repeated rows get equal results; an empty table gives an empty result;
    other columns are ignored.
    """
    x = cut(measured(docs))
    label = labels.where("quality is not null and doc_id is not null").where(remainder(5) != 0).select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = cut(x.join(label, "doc_id").select("x", "y"))
    k = len(STATISTICS)
    sums = rows.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums["n"]:
        scored = x.select("doc_id", F.lit(0.5).alias("score"))
    else:
        kernel = Kernel(np.array([sums[f"m{i}"] for i in range(k)]), np.array([sums[f"s{i}"] for i in range(k)]))
        square, target, n = _normal_equations(rows, kernel)
        weights = np.linalg.solve(square + RIDGE * n * np.diag([1.0] * FEATURES + [1e-9]), target)
        bins = _raw(rows, kernel, weights).groupBy(_bin(F.col("raw")).alias("b")).agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
        positive, count = np.zeros(BINS), np.zeros(BINS)
        for r in bins:
            positive[r["b"]], count[r["b"]] = r["p"], r["n"]
        rate = np.clip(isotonic(positive, count), 0, 1)
        scored = _raw(x, kernel, weights).select("doc_id", F.element_at(F.array(*[F.lit(float(v)) for v in rate]), _bin(F.col("raw")) + 1).alias("score"))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
