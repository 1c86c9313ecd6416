"""Windows and samples of series of any length; levels, scores and annotations of ontologies of any depth."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom import catalog
from netloom.operators import learn, ontology, ranking


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def series(spark):
    """One series with most of the rows, short ones, one of a single point, and rows without id or value."""
    draw = random.Random(4)
    data = {1: [draw.random() for _ in range(900)], 2: [draw.random() for _ in range(40)], 3: [0.5] * 17, 4: [1.0] * 16, 5: [2.0]}
    table = [(k, i, v) for k, x in data.items() for i, v in enumerate(x)] + [(None, 0, 1.0), (2, 99, None)]
    draw.shuffle(table)
    return data, learn.points(spark.createDataFrame(table, "user long, t long, v double").repartition(7), "user", ["t"], "v")


def test_points_are_numbered_in_order(series):
    data, points = series
    assert rows(points.select("id", "at", "x", "total")) == sorted((k, i, v, len(x)) for k, x in data.items() for i, v in enumerate(x))


@pytest.mark.parametrize(("length", "step", "size"), [(16, 1, 4096), (16, 1, 16), (5, 3, 7), (1, 1, 2), (40, 2, 8)])
def test_windows_of_ranges_are_those_of_whole_series(series, length, step, size):
    data, points = series
    want = sorted((k, i, x[i : i + length]) for k, x in data.items() for i in range(0, max(0, len(x) - length), step))
    assert rows(learn.windows(points, length, step, size).select("id", "at", "x")) == want


@pytest.mark.parametrize("most", [5, 60, 400, 100_000])
def test_sampled_windows_fill_the_quotas(series, most):
    data, points = series
    rest = sum(map(len, data.values())) - len(data)
    quota = {k: 1 + math.floor((len(x) - 1) / rest * (most - len(data))) for k, x in data.items()}
    assert dict(rows(learn.quotas(points, most))) == quota
    got = rows(learn.sampled_windows(points, 16, most).select("id", "at", "x"))
    for k, x in data.items():
        own = [(at, w) for i, at, w in got if i == k]
        assert len(own) == len({at for at, _ in own}) == min(quota[k], max(0, len(x) - 16))
        assert all(w == x[at : at + 16] for at, w in own)
    with pytest.raises(ValueError):
        learn.quotas(points, 4)


def test_more_series_than_samples_give_a_window_each(series):
    data, points = series
    got = rows(learn.sampled_windows(points, 16, most=2).select("id", "at", "x"))
    assert [i for i, _, _ in got] == [k for k, x in data.items() if len(x) > 16]
    assert all(w == data[i][at : at + 16] for i, at, w in got)
    assert learn.codebook(points, clusters=2, most=2).shape == (2, 16)


def test_query_of_sample_sizes_with_more_series_than_samples(spark, tmp_path):
    """4,500 users with 17 to 19 events each, where the query asks for 4,000 windows."""
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 3 + 16))
    table = spark.range(4500).select(F.col("id").alias("user_id"), n.alias("event_id"))
    table.withColumns({"ts": F.timestamp_seconds("event_id"), "value": F.rand(1)}).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.sql(catalog.oracle_sql()["vq_sample_sizes"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert len(want) == 4500
    assert rows(catalog.queries()["vq_sample_sizes"](spark, str(tmp_path))) == sorted(want)


def test_shares_of_centroids_against_plain_loops(series):
    data, points = series
    centroids = np.random.default_rng(2).random((5, 16))
    want = {}
    for k, x in data.items():
        for i in range(len(x) - 16):
            code = int(((np.array(x[i : i + 16]) - centroids) ** 2).sum(1).argmin())
            want[k, code] = want.get((k, code), 0) + 1
    got = {(r["id"], r["code"]): (r["n"], r["share"]) for r in learn.quantised(points, centroids).collect()}
    assert {k: n for k, (n, _) in got.items()} == want
    assert all(abs(share - n / max(0, len(data[k[0]]) - 16)) < 1e-12 for k, (n, share) in got.items())


def test_codebook_finds_planted_shapes(spark):
    waves = [(k, i, float(k % 2) * 5 + math.sin(i)) for k in range(6) for i in range(60)]
    book = learn.codebook(learn.points(spark.createDataFrame(waves, "id long, t long, v double"), "id", ["t"], "v"), clusters=2, most=60)
    assert sorted(round(float(c.mean())) for c in book) == [0, 5]


def test_ordered_rank_of_equal_rows_and_nulls(spark):
    table = [("a", None)] * 3 + [("a", 1)] * 50 + [("b", 2)] + [("a", 0)]
    got = rows(ranking.ordered_rank(spark.createDataFrame(table, "k string, v long").repartition(4), "k", ["v"]).select("k", "at", F.coalesce("v", F.lit(-1)), "total"))
    assert got == sorted([("a", i, v, 54) for i, v in enumerate([-1] * 3 + [0] + [1] * 50)] + [("b", 0, 2, 1)])
    assert ranking.ordered_rank(spark.createDataFrame([], "k string, v long"), "k", ["v"]).count() == 0


def plain_levels(rel):
    up = {}
    for c, p in rel:
        up.setdefault(c, set()).add(p)
        up.setdefault(p, set())
    near, far = {}, {}

    def walk(t):
        if t not in near:
            for p in up[t]:
                walk(p)
            near[t] = 1 + min((near[p] for p in up[t]), default=-1)
            far[t] = 1 + max((far[p] for p in up[t]), default=-1)

    for t in up:
        walk(t)
    return sorted((t, near[t], far[t]) for t in up)


@pytest.mark.parametrize("seed", range(3))
def test_levels_against_recursion(spark, seed):
    """Chains of single parents between terms with several, at random."""
    draw = random.Random(seed)
    rel = set()
    for i in range(1, 300):
        for p in draw.sample(range(max(0, i - 12), i), k=min(i, draw.choice([1, 1, 1, 1, 2, 3]))):
            if draw.random() > 0.03:
                rel.add((f"t{i:03d}", f"t{p:03d}"))
    df = spark.createDataFrame(sorted(rel) * 2, "child string, parent string")
    assert rows(ontology.levels(df)) == plain_levels(rel)


def test_a_chain_of_very_many_terms(spark):
    n = 100_000
    rel = spark.range(n).select(F.format_string("t%06d", F.col("id") + 1).alias("child"), F.format_string("t%06d", "id").alias("parent"))
    got = ontology.levels(rel)
    assert got.count() == n + 1 and got.where("depth <> level or format_string('t%06d', depth) <> id").isEmpty()


def test_loops_below_several_parents(spark):
    for loop in ([("a", "r"), ("a", "c"), ("b", "a"), ("c", "b")], [("a", "b"), ("b", "c"), ("c", "a")], [("x", "x")]):
        with pytest.raises(ontology.CycleError):
            ontology.levels(spark.createDataFrame([("z", "r"), *loop], "child string, parent string"))
    none = spark.createDataFrame([], "child string, parent string")
    assert ontology.levels(none).count() == 0 and ontology.carried(spark.createDataFrame([], "seq string, term string, score double"), none).count() == 0


@pytest.mark.parametrize("most", [64, 3])
def test_scores_go_up_by_levels_as_by_the_closure(spark, most):
    draw = random.Random(8)
    rel = [(f"t{i:02d}", f"t{p:02d}") for i in range(1, 60) for p in draw.sample(range(max(0, i - 6), i), k=min(i, draw.choice([1, 2])))]
    scored = [(f"s{draw.randrange(9)}", f"t{draw.randrange(66):02d}", round(draw.random(), 3)) for _ in range(300)]
    df, by = spark.createDataFrame(rel, "child string, parent string"), spark.createDataFrame(scored, "seq string, term string, score double")
    above = {}
    for t, a in rows(ontology.closure(df)):
        above.setdefault(t, []).append(a)
    want = {}
    for s, t, v in scored:
        for a in above.get(t, []):
            want[s, a] = max(v, want.get((s, a), 0))
    ontology.MOST_LEVELS, before = most, ontology.MOST_LEVELS
    try:
        assert rows(ontology.propagate_scores(by, df)) == sorted((*k, v) for k, v in want.items())
        assert rows(ontology.replenish(by, df)) == sorted(want)
    finally:
        ontology.MOST_LEVELS = before


@pytest.mark.parametrize(("size", "sent"), [(32, 1 << 15), (1, 2), (1000, 1)])
def test_densified_tells_every_pair_once(spark, size, sent):
    """Sequences with all, some and no terms, one without a name, a score that is null, and a term that is not known."""
    known = [f"t{i}" for i in range(40)]
    scored = {("all", t): 0.5 for t in known} | {("some", t): 0.25 for t in known[::7]} | {("some", "t1"): None, ("some", "odd"): 1.0}
    best = spark.createDataFrame([(s, t, x) for (s, t), x in scored.items()] + [(None, "t3", 0.75)], "seq string, term string, score double")
    sequences = spark.createDataFrame([("all",), ("some",), ("none",), (None,)], "seq string")
    got = ontology.densified(best, sequences, spark.createDataFrame([(t,) for t in known + ["t0"]], "id string"), size, sent).collect()
    assert len(got) == 4 * 40
    assert {(r["seq"], r["term"]): r["score"] for r in got} == {(s, t): scored.get((s, t)) or 0.0 for s in ("all", "some", "none", None) for t in known}


def test_dense_predictions_shuffle_no_grid(spark):
    rows = spark.createDataFrame([("s1", "x", 0.5), ("s2", "p", 0.25)], "seq string, term string, score double")
    rel = spark.createDataFrame([("x", "p"), ("p", "r")], "child string, parent string")
    alt = spark.createDataFrame([], "alt_id string, id string")
    got = ontology.load_predictions(rows, ontology.terms(rel), alt, rel)
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("s1", "p", 0.5), ("s1", "r", 0.5), ("s1", "x", 0.5), ("s2", "p", 0.25), ("s2", "r", 0.25), ("s2", "x", 0.0)]
