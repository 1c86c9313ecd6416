import random

from pyspark.sql import functions as F

from netloom.operators import network, propagate
from netloom.operators.components import connected_components
from netloom.operators.ranking import gapless_rank

EDGES = [("a", "b", 0.9), ("a", "c", 0.6), ("b", "c", 0.3), ("c", "d", 0.8)]


def small(spark):
    return network.Network(spark.createDataFrame([(x,) for x in "abcde"], "id string"), spark.createDataFrame(EDGES, "src string, dst string, w double"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_degrees_and_summary(spark):
    net = small(spark)
    got = {r["id"]: (r["degree"], round(r["weighted_degree"], 6)) for r in network.degrees(net).collect()}
    assert got == {"a": (2, 1.5), "b": (2, 1.2), "c": (3, 1.7), "d": (1, 0.8), "e": (0, 0.0)}
    s = network.summary(net).first()
    assert (s["n_vertices"], s["n_edges"], s["n_singletons"], s["sparsity"]) == (5, 4, 1, 0.4)
    assert rows(network.hubs(net, 1).select("id")) == [("c",)]
    assert rows(network.hubs(net, 2).select("id")) == [("a",), ("b",), ("c",)]
    assert rows(network.filter_edges(net, 0.6).edges.select("src", "dst")) == [("a", "b"), ("a", "c"), ("c", "d")]
    assert {r["component"] for r in network.components(net).collect()} == {"a", "e"}


def test_loader(spark):
    raw = [("1", "2", "-0.5", 1), ("2", "1", "0.7", 2), ("3", "3", "0.9", 3), ("4", "5", "NA", 4)]
    net = network.from_edges(spark.createDataFrame(raw, "src string, dst string, weight string, line long"))
    assert rows(net.vertices) == [("1",), ("2",), ("3",)]
    assert rows(net.edges) == [("1", "2", 0.7)]
    only = network.from_edges(spark.createDataFrame(raw, "src string, dst string, weight string, line long"), spark.createDataFrame([("1",), ("9",)], "id string"))
    assert rows(only.vertices) == [("1",), ("9",)] and only.edges.count() == 0


def test_merge(spark):
    other = network.Network(spark.createDataFrame([(x,) for x in "abdf"], "id string"), spark.createDataFrame([("a", "b", 0.5), ("b", "d", 0.4)], "src string, dst string, w double"))
    weights = lambda s: {(r["src"], r["dst"]): round(r["w"], 6) for r in network.merge(small(spark), other, s).edges.collect()}
    assert weights("min") == {("a", "b"): 0.5}
    assert weights("max") == {("a", "b"): 0.9, ("a", "c"): 0.6, ("b", "c"): 0.3, ("c", "d"): 0.8, ("b", "d"): 0.4}
    assert weights("add")["a", "b"] == 1.4
    assert rows(network.merge(small(spark), other).vertices) == [(x,) for x in "abcdef"]


def test_flow(spark):
    seeds = spark.createDataFrame([("a",)], "id string")
    want = {
        "raw": [("a", 0), ("b", 2.7), ("c", 2.325), ("d", 0.820069), ("e", 0)],
        "out": [("a", 0), ("b", 1.8), ("c", 1.6), ("d", 0.546713), ("e", 0)],
        "in": [("a", 0), ("b", 2.25), ("c", 1.411765), ("d", 0.503155), ("e", 0)],
    }
    for capacity, scores in want.items():
        got = propagate.functional_flow(small(spark), seeds, 3, capacity).select("id", F.round("score", 6))
        assert rows(got) == [(i, float(s)) for i, s in scores]
    nobody = propagate.functional_flow(small(spark), spark.createDataFrame([("zz",)], "id string"), 2)
    assert {r["score"] for r in nobody.collect()} == {0.0}


def test_components_of_chains_stars_and_random_graphs(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 180)] + [(200 + draw.randrange(60), 200 + draw.randrange(60)) for _ in range(45)] + [(500, 500), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gapless_rank(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("v"))
    got = gapless_rank(df, ["k"], [F.col("v")], "r", ranges=16).groupBy("k").agg(F.sort_array(F.collect_list("r")).alias("r")).collect()
    assert all(r["r"] == list(range(len(r["r"]))) for r in got) and sum(len(r["r"]) for r in got) == 1000


def test_random_operators_keep_their_invariants(spark):
    net = network.random_network(spark.range(60).select(F.format_string("v%03d", "id").alias("id")), 300, seed=3)
    assert net.edges.where("src < dst").distinct().count() == 300
    turned = network.rewire(net, 1.0, seed=5)
    assert rows(network.degrees(turned).select("id", "degree")) == rows(network.degrees(net).select("id", "degree"))
    assert rows(turned.edges) != rows(net.edges) and turned.edges.select("src", "dst").distinct().count() == 300
    assert rows(network.rewire(net, 1.0, seed=5).edges) == rows(turned.edges)


def test_random_field_clamps_seeds_and_repeats(spark):
    seeds = spark.createDataFrame([("a",), ("zz",)], "id string")
    one = rows(propagate.random_field(small(spark), seeds, alpha=-1.0, beta=0.9, gamma=1.2, chains=4, burn_in=2, sweeps=2, lag=1))
    assert dict(one)["a"] == 1.0 and set(dict(one)) == set("abcde") and all(0 <= v <= 1 for _, v in one)
    assert one == rows(propagate.random_field(small(spark), seeds, alpha=-1.0, beta=0.9, gamma=1.2, chains=4, burn_in=2, sweeps=2, lag=1))


def test_largest_component_and_projection(spark):
    assert rows(network.largest_component(small(spark)).vertices) == [(x,) for x in "abcd"]
    kept = network.project(small(spark), spark.createDataFrame([("a",), ("b",), ("x",)], "id string"))
    assert rows(kept.vertices) == [("a",), ("b",), ("x",)] and rows(kept.edges) == [("a", "b", 0.9)]
