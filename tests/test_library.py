"""Limits, persistence and exact references of library operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom import cli
from netloom.operators import evaluate, learn, matrix, network, ontology, propagate
from netloom.sources import sinks, text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def chain(spark, n):
    return spark.range(n).select(F.format_string("t%04d", F.col("id") + 1).alias("child"), F.format_string("t%04d", "id").alias("parent"))


def test_deep_ontologies_keep_all_levels(spark):
    rel = chain(spark, 250)
    assert rows(ontology.depths(rel)) == [(f"t{k:04d}", k) for k in range(251)] == rows(ontology.topological(rel))
    assert ontology.closure(rel).count() == 251 * 252 // 2
    ends = spark.createDataFrame([("t0000",), ("t0250",)], "id string")
    assert rows(ontology.subontology(rel, ends)) == [("t0250", "t0000")]


@pytest.mark.parametrize("loop", [[("a", "a")], [("a", "b"), ("b", "a")], [("x", "root"), ("y", "x"), ("x", "y")]])
def test_loops_are_errors(spark, loop):
    rel = spark.createDataFrame([("x", "root"), *loop], "child string, parent string")
    for f in (ontology.closure, ontology.depths, ontology.topological):
        with pytest.raises(ontology.CycleError):
            f(rel)


def test_programs_print_every_row(spark, tmp_path, capsys):
    net = network.random_network(spark.range(80).select(F.format_string("v%03d", "id").alias("id")), 1500, seed=3)
    sinks.save_network(net, str(tmp_path / "net"))
    cli.main(["print-net", "-n", str(tmp_path / "net"), "-cutoff", "0"], spark)
    said = capsys.readouterr().out.strip().split("\n")
    assert len(said) == 1501 and len({tuple(x.split("\t")[:2]) for x in said[1:]}) == 1500


def test_long_configurations(spark, tmp_path):
    (tmp_path / "c").write_text("# first\n" + "".join(f"name{k} = {k}\n" for k in range(100_010)))
    assert len(text.read_config(spark, str(tmp_path / "c"))) == 100_010


def test_rewiring_a_share_of_the_edges(spark):
    net = network.random_network(spark.range(200).select(F.format_string("v%03d", "id").alias("id")), 600, seed=3)
    before = {tuple(r)[:2] for r in net.edges.collect()}
    for share in (0.0, 0.1, 0.3):
        after = network.rewire(net, share, seed=2)
        moved = len(before - {tuple(r)[:2] for r in after.edges.collect()})
        assert after.edges.count() == 600 and moved <= 2 * share * 600 and moved >= 1.2 * share * 600
        assert rows(network.degrees(after).select("id", "degree")) == rows(network.degrees(net).select("id", "degree"))
    full = network.random_network(spark.range(5).select(F.col("id").cast("string").alias("id")), 10, seed=1)
    assert rows(network.rewire(full, 1.0).edges) == rows(full.edges)


def test_random_field_against_its_stationary_law(spark):
    """Ten vertices, two of them seeds: the chain of synchronous draws over all 256 states has the sampled means."""
    names = [f"v{k}" for k in range(10)]
    pairs = [(a, b) for a, b in itertools.combinations(range(10), 2) if (a * 7 + b * 3) % 4 == 0]
    net = network.Network(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame([(names[a], names[b], 1.0) for a, b in pairs], "src string, dst string, w double"))
    alpha, beta, gamma, seeds, free = -0.6, 0.7, 1.1, (0, 3), [k for k in range(10) if k not in (0, 3)]
    states = [[int(k in seeds or (s >> free.index(k)) & 1) for k in range(10)] for s in range(256)]
    around = {k: [a + b - k for a, b in pairs if k in (a, b)] for k in range(10)}
    step = np.ones((256, 256))
    for i, x in enumerate(states):
        one = {}
        for k in free:
            m1 = sum(x[j] for j in around[k])
            one[k] = 1 / (1 + math.exp(-(alpha + (beta - 1) * (len(around[k]) - m1) + (gamma - beta) * m1)))
        for j, y in enumerate(states):
            step[i, j] = math.prod(one[k] if y[k] else 1 - one[k] for k in free)
    law = np.linalg.matrix_power(step, 400)[0]
    want = {names[k]: float(sum(p * x[k] for p, x in zip(law, states, strict=True))) for k in range(10)}
    got = dict(rows(propagate.random_field(net, spark.createDataFrame([("v0",), ("v3",)], "id string"), alpha, beta, gamma, burn_in=12, sweeps=20, lag=2, chains=40, seed=4)))
    assert got["v0"] == got["v3"] == 1.0
    assert all(abs(got[n] - want[n]) < 0.06 for n in names)


def test_confusion_at_thresholds(spark):
    draw = np.random.default_rng(2)
    data = [("ab"[int(k)], float(round(s, 2)), bool(y)) for k, s, y in zip(draw.integers(0, 2, 300), draw.random(300), draw.integers(0, 2, 300), strict=True)]
    taus = [0.0, 0.25, 0.5, 0.5, 0.77, 1.5]
    got = evaluate.confusion_at(spark.createDataFrame(data, "k string, score double, label boolean"), spark.createDataFrame([(t,) for t in taus], "tau double"), keys=["k"])
    count = lambda k, f: float(sum(1 for g, s, y in data if g == k and f(s, y)))
    want = sorted((k, t, count(k, lambda s, y: s >= t and y), count(k, lambda s, y: s >= t and not y), count(k, lambda s, y: s < t and not y), count(k, lambda s, y: s < t and y)) for k in "ab" for t in sorted(set(taus)))
    assert rows(got.select("k", "tau", "tp", "fp", "tn", "fn")) == want
    assert evaluate.confusion_at(spark.createDataFrame([], "score double, label boolean"), spark.createDataFrame([(0.5,)], "tau double")).count() == 0


def test_models_come_back_from_disk(spark, tmp_path):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(150, 8))
    y = np.column_stack((x[:, 0] > 0, x[:, 1] > 0)).astype(float)
    y[:, 0] = y.max(1)
    data = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y array<double>")
    model = learn.train_terms(data, ["up", "down"], [("down", "up")], learn.Settings(models=2, epochs=8, loss="mse_con_reg"))
    learn.save_terms(spark, model, str(tmp_path / "m"))
    back = learn.load_terms(spark, str(tmp_path / "m"))
    predicted = learn.predict_terms(data, model)
    assert rows(predicted) == rows(learn.predict_terms(data, back)) and back.nets[0].settings.hidden == (10,)
    told = learn.is_consistent(predicted, model.nets[0].settings.ancestors)
    assert told.where("consistent").count() == 150
    wrong = predicted.select("id", F.array(F.lit(0.1), F.lit(0.9)).alias("f"))
    assert learn.is_consistent(wrong, model.nets[0].settings.ancestors).where("consistent").count() == 0
    learn.save_codebook(spark, x[:4], str(tmp_path / "c"))
    assert np.allclose(learn.load_codebook(spark, str(tmp_path / "c")), x[:4])


def test_empty_learning(spark):
    none = spark.createDataFrame([], "id long, x array<double>, y array<double>")
    one = spark.createDataFrame([(1, [0.5], [1.0])], none.schema)
    model = learn.train_terms(none, ["t"], [])
    assert learn.train(none) == [] and rows(learn.predict_terms(one, model)) == [(1, None)] == rows(learn.predict(one, []))
    assert rows(learn.predict_out_of_bag(one, [])) == [(1, None, 0)]


def test_stochastic_descent_learns(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    data = spark.createDataFrame([(i, a.tolist(), [float(b)]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y array<double>").repartition(4)
    nets = learn.train(data, learn.Settings(trainer="sgd", rate=0.5, epochs=12, hidden=(4,)))
    got = {r["id"]: r["f"][0] > 0.5 for r in learn.predict(data, nets).collect()}
    assert np.mean([got[i] == bool(v) for i, v in enumerate(y)]) > 0.9


def test_feature_selection_is_welchs(spark):
    from netloom.functions.stats import student_p

    draw = np.random.default_rng(5)
    y = (np.arange(300) % 3 == 0).astype(float)
    x = draw.normal(size=(300, 9))
    x[:, 2] += 3 * y
    x[:, 7] = 4.0
    data = spark.createDataFrame([(a.tolist(), [float(b)]) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(3)
    p = []
    for j in range(9):
        a, b = x[y < 0.5, j], x[y > 0.5, j]
        va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        p.append((2.0 if va + vb == 0 else student_p((a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))), j))
    assert learn.select_features(data, 9, 1, least=3) == sorted(j for _, j in sorted(p)[:3])
    assert learn.select_features(data, 9, 1, least=1) == [2]


def test_matrix_edits(spark):
    cells = matrix.from_rows(spark.createDataFrame([("r", [1.0, 2.0]), ("s", [3.0, 4.0])], "row_tag string, x array<double>"))
    assert rows(cells) == [("r", "1", 1.0), ("r", "2", 2.0), ("s", "1", 3.0), ("s", "2", 4.0)]
    gone = matrix.remove_cells(cells, spark.createDataFrame([("r", "2")], "row_tag string, col_tag string"))
    grid = matrix.project(gone, spark.createDataFrame([("r",), ("z",)], "row_tag string"))
    assert rows(grid) == [("r", "1", 1.0), ("r", "2", 0.0), ("z", "1", 0.0), ("z", "2", 0.0)]
    twice = matrix.subset(cells, spark.createDataFrame([(0, "s"), (1, "s")], "at long, row_tag string"))
    assert twice.count() == 4


def test_equal_ontologies(spark):
    a = spark.createDataFrame([("b", "a"), ("c", "b")], "child string, parent string")
    b = spark.createDataFrame([("b", "a"), ("c", "a")], "child string, parent string")
    assert ontology.equal(a, a.orderBy("parent")) and not ontology.equal(a, b) and ontology.size(a) == 3
