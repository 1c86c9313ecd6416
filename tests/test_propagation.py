"""Vertex cuts of flow and field, and the rule that ends burn-in and sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import network, propagate
from netloom.plans import fixtures as fx


def star(spark, leaves, chords):
    """A hub with ``leaves`` edges, and edges among the leaves."""
    rays = spark.range(leaves).select(F.lit("hub").alias("src"), F.format_string("v%06d", "id").alias("dst"), (0.5 + F.pmod(F.xxhash64("id"), F.lit(100)) / 200).alias("w"))
    ring = spark.range(chords).select(F.format_string("v%06d", "id").alias("src"), F.format_string("v%06d", F.pmod(F.col("id") * 7 + 1, F.lit(leaves))).alias("dst"), F.lit(0.3).alias("w")).where("src <> dst")
    edges = rays.union(ring).select(*network.canonical(F.col("src"), F.col("dst")), "w").groupBy("src", "dst").agg(F.max("w").alias("w"))
    return network.Network(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)


def close(a, b):
    a, b = ({tuple(r)[:-1]: r["score"] for r in df.collect()} for df in (a, b))
    return a.keys() == b.keys() and all(x == b[k] or abs(x - b[k]) < 1e-9 * max(1, abs(x)) for k, x in a.items())


@pytest.mark.parametrize("capacity", propagate.CAPACITIES)
def test_flow_with_hubs_is_flow_without(spark, capacity):
    net = star(spark, 3000, 2500)
    seeds = spark.createDataFrame([("v000003",), ("v000700",), ("hub",)], "id string")
    assert network.hub_ids(net.edges) == ["hub"] and network.hub_ids(net.edges, 1) == []
    assert close(propagate.functional_flow(net, seeds, 3, capacity), propagate.functional_flow(net, seeds, 3, capacity, share=1))
    folds = seeds.select("id", F.lit(1).alias("fold")).union(seeds.limit(2).select("id", F.lit(2).alias("fold"))).select("fold", "id")
    assert close(propagate.functional_flow(net, folds, 2, capacity), propagate.functional_flow(net, folds, 2, capacity, share=1))


def test_arcs_of_a_hub_lie_in_many_tasks(spark):
    """Arcs that are dealt by a hub would be one partition with half of all rows."""
    net = star(spark, 30_000, 0)
    spread = lambda pieces: [r["n"] for p in pieces for r in p.arcs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    links = network.arcs(net.edges)
    cut = spread(propagate.vertex_cut(links, ["hub"]))
    assert sum(cut) == 60_000 and max(cut) < 2 * np.median(cut)
    assert max(spread(propagate.vertex_cut(links, []))) >= 30_000


def test_field_with_hubs_is_field_without(spark):
    net = star(spark, 2500, 2000)
    seeds = spark.createDataFrame([("v000003",), ("v000700",)], "id string")
    ran = [{r["id"]: r["score"] for r in propagate.random_field(net, seeds, -0.5, 0.9, 1.1, burn_in=2, sweeps=4, lag=2, chains=3, share=s).collect()} for s in (1000, 1)]
    assert ran[0] == ran[1]


def long_run(ids, edges, seeds, alpha, beta, gamma, burn_in, sweeps, lag, chains=4):
    """The same field by dense matrices, as one would run it on one machine."""
    at = {v: i for i, v in enumerate(ids)}
    near = np.zeros((len(ids), len(ids)), np.float32)
    for a, b in edges:
        near[at[a], at[b]] = near[at[b], at[a]] = 1
    m, fixed = near.sum(1)[:, None], np.isin(ids, seeds)[:, None]
    draw = np.random.default_rng(11)
    x = (fixed | (draw.random((len(ids), chains)) < fixed.mean())).astype(np.float32)
    total, kept = np.zeros(len(ids)), 0
    for t in range(1, burn_in + sweeps + 1):
        m1 = near @ x
        p = 1 / (1 + np.exp(-(alpha + (beta - 1) * (m - m1) + (gamma - beta) * m1)))
        x = (fixed | (draw.random(x.shape) < p)).astype(np.float32)
        if t > burn_in and (t - burn_in) % lag == 0:
            total += x.mean(1)
            kept += 1
    return total / kept


def test_rule_agrees_with_a_long_run(spark, sf_dir):
    """Scores of the registered query against 100 sweeps of burn-in and 2,000 of sampling."""
    from netloom import catalog

    net = catalog._net(spark, sf_dir)
    ids = sorted(r["id"] for r in net.vertices.collect())
    edges = [(r["src"], r["dst"]) for r in net.edges.collect()]
    seeds = [r["id"] for r in fx.genes(spark, sf_dir).where("label").collect()]
    want = long_run(ids, edges, seeds, -1.0, 0.9, 1.2, 100, 2000, 10)
    got = {r["id"]: r["score"] for r in catalog.mrf_scores(spark, sf_dir).collect()}
    apart = np.array([got[v] - w for v, w in zip(ids, want, strict=True)])
    assert abs(apart.mean()) < 0.01 and np.sqrt((apart**2).mean()) < 0.03, (apart.mean(), np.abs(apart).max())


def test_rule_on_trivial_fields(spark):
    one = network.Network(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, w double"))
    all_seeds = propagate.random_field(one, one.vertices)
    assert {r["score"] for r in all_seeds.collect()} == {1.0}
    with pytest.raises(ValueError):
        propagate.random_field(one, one.vertices, burn_in=3)
    # two vertices that hold each other in place: chains from all and from none never agree
    with pytest.warns(UserWarning, match="disagree"):
        propagate.MOST_SWEEPS, before = 40, propagate.MOST_SWEEPS
        try:
            propagate.random_field(one, one.vertices.limit(0), alpha=-40.0, beta=1.0, gamma=81.0, chains=4)
        finally:
            propagate.MOST_SWEEPS = before


def test_chains_that_share_a_number_are_counted_apart(spark):
    """A vertex is 1 where 300 neighbours are, in each of 16 chains; the other one has 299, so no count may carry into the next."""
    assert [len(p) for p in propagate._packs(16, 9)] == [7, 7, 2]
    edges = [(hub, f"{hub}{i}", 1.0) for hub in "ab" for i in range(300)]
    net = network.from_edges(spark.createDataFrame([(s, d, w, i) for i, (s, d, w) in enumerate(edges)], "src string, dst string, weight double, line long"))
    seeds = net.vertices.where("id not in ('a', 'b', 'b7')")
    got = propagate.random_field(net, seeds, alpha=-100 * 299.5, beta=1.0, gamma=101.0, burn_in=2, sweeps=2, lag=1)
    assert {r["id"]: r["score"] for r in got.where("id in ('a', 'b', 'b7', 'a7')").collect()} == {"a": 1.0, "b": 0.0, "b7": 0.0, "a7": 1.0}
