"""Ensembles on sampled terms, masks, row samples and wide axes against dense restatements."""

import random

import numpy as np
import pytest

from netloom.operators import learn, ontology

TERMS = [f"t{k}" for k in range(12)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rel(spark):
    draw = random.Random(3)
    links = {(f"t{i}", f"t{p}") for i in range(1, 12) for p in draw.sample(range(max(0, i - 4), i), k=min(i, draw.choice([1, 2])))}
    return sorted(links), spark.createDataFrame(sorted(links), "child string, parent string")


@pytest.fixture(scope="module")
def data(spark, rel):
    """Labels that hold for a term hold for all above it."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(240, 7))
    y = np.zeros((240, 12))
    for i in range(11, -1, -1):
        y[:, i] = np.maximum(y[:, i], x[:, i % 7] > 1.1)
        for c, p in rel[0]:
            if c == f"t{i}":
                y[:, int(p[1:])] = np.maximum(y[:, int(p[1:])], y[:, i])
    return x, y, spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y array<double>").repartition(4)


def plain_contraction(links, kept):
    """Drop terms one by one; the children of each go to its parents."""
    links = set(links)
    for t in TERMS:
        if t not in kept:
            up, down = {p for c, p in links if c == t}, {c for c, p in links if p == t}
            links = {r for r in links if t not in r} | {(c, p) for c in down for p in up}
    return sorted(links)


def plain_above(links, terms):
    """A[i][j] = 1 where i is j or above it, by walking."""
    out = np.zeros((len(terms), len(terms)))
    for j, t in enumerate(terms):
        seen, at = {t}, [t]
        while at:
            now = at.pop()
            for c, p in links:
                if c == now and p not in seen:
                    seen.add(p)
                    at.append(p)
        for a in seen:
            out[terms.index(a), j] = 1
    return out


def test_members_contracted_together_as_one_by_one(spark, rel):
    drawn = learn.drawn_terms(TERMS, 4, 5, seed=2)
    assert len({tuple(d) for d in drawn}) > 1 and all(len(set(d)) == 5 for d in drawn)
    chosen = spark.createDataFrame([(m, TERMS[i]) for m, own in enumerate(drawn) for i in own], "member int, id string")
    got = rows(ontology.subontologies(rel[1], chosen, 4).select("member", "child", "parent"))
    want = [(m, c, p) for m, own in enumerate(drawn) for c, p in plain_contraction(rel[0], {TERMS[i] for i in own})]
    assert got == sorted(want)


def test_ensemble_on_sampled_terms_against_dense_prediction(spark, rel, data, tmp_path):
    x, y, df = data
    settings = learn.Settings(models=3, epochs=6, loss="mse_con_reg", seed=5)
    model = learn.train_members(df, TERMS, rel[1], settings, per_member=5)
    drawn = learn.drawn_terms(TERMS, 3, 5, seed=5)
    scaled = model.scaler(x)
    want = np.zeros((len(x), 12))
    for net, own in zip(model.nets, drawn, strict=True):
        terms = [TERMS[i] for i in own]
        above = plain_above(plain_contraction(rel[0], set(terms)), terms)
        assert (net.settings.ancestors == above).all() and net.targets.tolist() == own and len(net.weights[-1][1]) == 5
        f = net.layers(scaled)[-1] @ above.T
        full = np.zeros_like(want)
        full[:, own] = f
        best = np.stack([full[:, plain_above(rel[0], TERMS)[i] > 0].max(1) for i in range(12)], 1)
        want += best / above.sum(1).max() / 3
    got = np.array([r["f"] for r in learn.predict_members(df, model).orderBy("id").collect()])
    assert np.allclose(got, want)
    held = learn.is_consistent(learn.predict_members(df, model), plain_above(rel[0], TERMS))
    assert held.where("not consistent").isEmpty()
    learn.save_terms(spark, model, str(tmp_path / "m"))
    back = learn.load_terms(spark, str(tmp_path / "m"))
    assert rows(learn.predict_members(df, back)) == rows(learn.predict_members(df, model)) and back.nets[0].settings.relations == model.nets[0].settings.relations


def test_all_terms_when_as_many_are_asked_for(data, rel):
    model = learn.train_members(data[2], TERMS, rel[1], learn.Settings(models=2, epochs=2))
    assert all(n.targets.tolist() == list(range(12)) for n in model.nets)
    assert learn.train_members(data[2].limit(0), TERMS, rel[1], learn.Settings(models=2)).nets == []


def test_gradients_of_a_member_sum_over_its_own_terms(data):
    """The first step of a member against a gradient by finite differences on its columns."""
    x, y, _ = data
    net = learn.Net.start(learn.Settings(hidden=(3,)), 7, 12, 1, np.array([1, 4, 9]))
    w = np.random.default_rng(0).random(len(x))
    mask = (np.random.default_rng(1).random((len(x), 3)) > 0.4).astype(float)
    g, _ = net.gradient(x, y, w, mask)
    value = lambda n: float((w[:, None] * mask * 0.5 * (n.layers(x)[-1] - y[:, [1, 4, 9]]) ** 2).sum() / 3)
    flat = net.flat()
    for i in (0, 5, 20, len(flat) - 1):
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert abs((value(net.moved(flat + step)) - value(net.moved(flat - step))) / 2e-5 - g[i]) < 1e-4 * max(1, abs(g[i]))


def test_masks_are_leaves_their_children_and_ten_at_least(rel, data):
    _, y, _ = data
    wide = np.hstack((y, np.zeros((len(y), 8))))
    links = tuple((int(c[1:]), int(p[1:])) for c, p in rel[0])
    above = plain_above(rel[0], TERMS)
    got = learn.target_mask(wide, np.arange(len(y)) * 7919, learn.Settings(relations=links))
    for row, mask in zip(y, got, strict=True):
        has = {i for i in range(12) if row[i]}
        leaf = {i for i in has if not any(j != i and above[i, j] for j in has)}
        due = leaf | {c for c, p in links if p in leaf}
        assert {i for i in range(20) if mask[i]} >= due and mask.sum() == max(10, len(due))
    assert got.std(0).min() >= 0 and (learn.target_mask(y[:, :3], np.arange(len(y)), learn.Settings()) == 1).all()


def test_masked_and_sampled_training_runs(data, rel):
    model = learn.train_members(data[2], TERMS, rel[1], learn.Settings(models=2, epochs=4, mask=True, max_rows=100))
    assert all(np.isfinite(n.flat()).all() for n in model.nets)
    key = np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)
    share = [learn.drawn_rows(key, m, learn.Settings(max_rows=5000), 20_000) for m in (0, 1)]
    assert all(abs(s.mean() - 0.25) < 0.02 for s in share) and abs((share[0] & share[1]).mean() - 0.0625) < 0.01
    assert learn.drawn_rows(key, 0, learn.Settings(max_rows=20_000), 20_000).all()


def test_combine_looks_at_terms_and_features(data, rel):
    one = learn.train_members(data[2], TERMS, rel[1], learn.Settings(models=1, epochs=1))
    assert len(learn.combine(one, one).nets) == 2
    other = learn.TermEnsemble(one.scaler, one.nets, TERMS[::-1], one.relations)
    with pytest.warns(UserWarning, match="differ"):
        assert learn.combine(one, other) is one


@pytest.mark.parametrize("retain", [0.6, 0.9])
def test_axes_of_wide_data_hold_what_the_exact_ones_hold(spark, retain):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 12)) @ draw.normal(size=(12, 150)) + 0.6 * draw.normal(size=(400, 150))
    x[:, 17] = 3.0
    df = spark.createDataFrame([(a.tolist(),) for a in x], "x array<double>").repartition(5)
    exact, near = learn.fit_scaler(df, list(range(150)), retain), learn.fit_scaler(df, list(range(150)), retain, wide=100)
    held = [((s(x) ** 2).sum() / (np.delete((x - s.mean) / s.sd, 17, 1) ** 2).sum()) for s in (exact, near)]
    assert abs(held[0] - held[1]) < 0.01 and abs(exact.axes.shape[1] - near.axes.shape[1]) <= 2
    assert np.allclose(near.axes.T @ near.axes, np.eye(near.axes.shape[1]), atol=1e-8)
