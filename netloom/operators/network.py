"""Undirected weighted networks as two DataFrames.

``vertices(id)`` and ``edges(src, dst, w)`` with ``src < dst``, ``w > 0`` and
one row per pair.  Ids are strings and compare by bytes.  Every operator is
linear in the edges; none builds a matrix or looks at all pairs of vertices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.components import connected_components
from netloom.operators.hubs import FEW_ROWS, SHARE
from netloom.operators.ranking import gapless_rank
from netloom.plans.session import cut


@dataclass(frozen=True)
class Network:
    vertices: DataFrame
    edges: DataFrame


def canonical(src: Column, dst: Column) -> list[Column]:
    return [F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")]


def from_edges(rows: DataFrame, nodes: DataFrame | None = None) -> Network:
    """A network from rows ``src, dst, weight`` and optionally ``line``.

    Weights count by absolute value; a weight that is no number drops its row
    and registers nothing.  The last row of a pair, in either direction, wins.
    A self-loop only registers its vertex; a zero weight is no edge.  With
    ``nodes(id)`` the vertices are exactly those, and rows that name others are
    dropped.  Without ``line`` a pair's largest weight wins.
    """
    order = F.col("line") if "line" in rows.columns else F.abs(F.expr("try_cast(weight AS DOUBLE)"))
    parsed = rows.select("src", "dst", F.abs(F.expr("try_cast(weight AS DOUBLE)")).alias("w"), order.alias("line")).where("w is not null and not isnan(w) and src is not null and dst is not null")
    if nodes is None:
        vertices = parsed.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    else:
        vertices = nodes.select("id").where("id is not null").distinct()
        parsed = parsed.join(vertices.withColumnRenamed("id", "src"), "src", "left_semi").join(vertices.withColumnRenamed("id", "dst"), "dst", "left_semi")
    pairs = parsed.where("src <> dst").select(*canonical(F.col("src"), F.col("dst")), "w", "line")
    return Network(vertices, pairs.groupBy("src", "dst").agg(F.max_by("w", F.struct("line", "w")).alias("w")).where("w > 0"))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select(F.explode(F.array(F.struct(F.col("src"), F.col("dst"), F.col("w")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w")))).alias("a")).select("a.*")


def ends(edges: DataFrame) -> DataFrame:
    """``id, w`` for both ends of every edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), "w")


def filter_edges(net: Network, tau: float) -> Network:
    """Keep edges of weight ``tau`` or more; all of them if ``tau`` is not positive."""
    return Network(net.vertices, net.edges.where(F.col("w") >= tau)) if tau > 0 else net


def edge_weights(net: Network, pairs: DataFrame) -> DataFrame:
    """Weight of each asked ``(src, dst)`` in either direction; 0 where there is no edge."""
    asked = pairs.select("src", "dst", F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b"))
    there = net.edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), "w")
    return asked.join(there, ["_a", "_b"], "left").select("src", "dst", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce(F.col("w") > 0, F.lit(False)).alias("has_edge"))


def set_edges(net: Network, changes: DataFrame) -> Network:
    """Upsert ``(src, dst, w)`` between known vertices; a weight of 0 removes the edge."""
    new = from_edges(changes.withColumnRenamed("w", "weight"), net.vertices)
    touched = changes.select(*canonical(F.col("src"), F.col("dst"))).distinct()
    return Network(net.vertices, net.edges.join(touched, ["src", "dst"], "left_anti").unionByName(new.edges))


def disconnect(net: Network, ids: DataFrame) -> Network:
    """Drop all edges of some vertices; the vertices stay."""
    kept = net.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Network(net.vertices, kept.select("src", "dst", "w"))


def remove_singletons(net: Network) -> Network:
    return Network(net.vertices.join(ends(net.edges).select("id"), "id", "left_semi"), net.edges)


def project(net: Network, ids: DataFrame) -> Network:
    """Induced network on listed ids; ids that the network lacks become vertices without edges."""
    wanted = ids.select("id").where("id is not null").distinct()
    inside = net.edges.join(wanted.withColumnRenamed("id", "src"), "src", "left_semi").join(wanted.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Network(wanted, inside.select("src", "dst", "w"))


def subgraph(net: Network, ids: DataFrame) -> Network:
    """Induced network on those listed ids that the network has."""
    return project(net, net.vertices.join(ids.select("id"), "id", "left_semi"))


def neighbors(net: Network, ids: DataFrame) -> DataFrame:
    """``id, neighbor, w`` for each listed vertex."""
    both = arcs(net.edges).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "w")
    return both.join(ids.select("id").distinct(), "id", "left_semi")


def degrees(net: Network) -> DataFrame:
    """``id, degree, weighted_degree`` for every vertex, edgeless ones included."""
    sums = ends(net.edges).groupBy("id").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))
    return net.vertices.join(sums, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"))


def singletons(net: Network) -> DataFrame:
    return net.vertices.join(ends(net.edges).select("id"), "id", "left_anti")


def hubs(net: Network, k: int = 1) -> DataFrame:
    """Vertices whose degree reaches the k-th largest, ties included.

    The k-th largest comes from the histogram of degrees, which has no more
    rows than there are different degrees.
    """
    degree = degrees(net)
    histogram = degree.groupBy("degree").count()
    above = histogram.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    limit = above.where(F.col("before") < k).agg(F.min("degree").alias("least"))
    return degree.join(F.broadcast(limit), F.col("degree") >= F.col("least")).select("id", "degree")


def summary(net: Network) -> DataFrame:
    """One row: counts of vertices, edges and singletons, and the share of pairs that are edges."""
    v = net.vertices.agg(F.count("*").alias("n_vertices"))
    e = net.edges.agg(F.count("*").alias("n_edges"))
    s = singletons(net).agg(F.count("*").alias("n_singletons"))
    n = F.col("n_vertices").cast("double")
    return v.join(e).join(s).withColumn("sparsity", F.try_divide(F.col("n_edges").cast("double"), n * (n - 1) / 2))


def interest(net: Network, ids: DataFrame, min_degree: int = 2) -> DataFrame:
    """One row: how many listed ids there are, and how many have ``min_degree`` edges or more."""
    return ids.select("id").distinct().join(degrees(net), "id", "left").agg(F.count("*").alias("n_listed"), F.coalesce(F.sum((F.col("degree") >= min_degree).cast("long")), F.lit(0)).alias("n_connected"))


def hub_ids(edges: DataFrame, share: int = SHARE) -> list[str]:
    """Vertices with over ``1 / share`` of the arcs, so no more than ``share``; none in a small network."""
    degree = ends(edges).groupBy("id").agg(F.count("*").alias("n"))
    total = 2 * edges.count()
    return [] if total < FEW_ROWS else [r["id"] for r in degree.where(F.col("n") * share > F.lit(total)).select("id").collect()]


def attach(rows: DataFrame, one: DataFrame, end: str, hubs: list[str]) -> DataFrame:
    """``rows`` with the columns of ``one`` (``id`` and others, a row for each vertex) for the vertex in ``end``.

    What is told of hubs goes out by broadcast, a row for each at most, so
    their rows stay where they are; all others meet in a shuffled join.
    """
    other = one.withColumnRenamed("id", end)
    if not hubs:
        return rows.join(other, end)
    hub = F.col(end).isin(hubs)
    return rows.where(~hub).join(other.where(~hub), end).unionByName(rows.where(hub).join(F.broadcast(other.where(hub)), end))


def normalised(net: Network, hubs: list[str] | None = None) -> DataFrame:
    """Arcs with ``out_w = w / sum of src`` and ``in_w = w / sum of dst``; with ``hubs`` known, theirs are not moved."""
    total = ends(net.edges).groupBy("id").agg(F.sum("w").alias("s"))
    a = attach(arcs(net.edges), total.withColumnRenamed("s", "s_src"), "src", hubs or [])
    a = attach(a, total.withColumnRenamed("s", "s_dst"), "dst", hubs or [])
    return a.select("src", "dst", "w", (F.col("w") / F.col("s_src")).alias("out_w"), (F.col("w") / F.col("s_dst")).alias("in_w"))


SCHEMES = {
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "add": lambda a, b: a + b,
}


def merge(one: Network, two: Network, scheme: str = "min", drop_singletons: bool = False) -> Network:
    """Union of the vertices; edge weights by ``scheme``, where a missing edge counts as 0."""
    if scheme == "min":
        joined = one.edges.join(two.edges.withColumnRenamed("w", "w2"), ["src", "dst"])
    else:
        joined = one.edges.join(two.edges.withColumnRenamed("w", "w2"), ["src", "dst"], "full")
    zero = F.lit(0.0)
    edges = joined.select("src", "dst", SCHEMES[scheme](F.coalesce("w", zero), F.coalesce("w2", zero)).alias("w")).where("w > 0")
    net = Network(one.vertices.select("id").union(two.vertices.select("id")).distinct(), edges)
    return remove_singletons(net) if drop_singletons else net


def components(net: Network) -> DataFrame:
    """``id, component`` for every vertex; a vertex without edges is its own component."""
    found = connected_components(net.edges.select("src", "dst"))
    return net.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_component(net: Network) -> Network:
    """Induced network on the component with most vertices, the one with the smallest id on a tie."""
    member = cut(components(net))
    best = member.groupBy("component").count().agg(F.min_by("component", F.struct(-F.col("count"), F.col("component"))).alias("component"))
    return project(net, member.join(F.broadcast(best), "component", "left_semi"))


def adjacency(net: Network, bilateral: bool = True, begin: int = 0, with_singletons: bool = True) -> DataFrame:
    """``idx, id, neighbors``: vertices numbered from ``begin`` in id order, and their neighbours' numbers.

    One list per vertex is as long as its degree.
    """
    ids = net.vertices if with_singletons else remove_singletons(net).vertices
    numbered = ordered(ids).select("id", (F.col("ord") + begin).alias("idx"))
    a = arcs(net.edges) if bilateral else net.edges
    pairs = a.join(numbered.select(F.col("id").alias("dst"), F.col("idx").alias("to")), "dst").groupBy("src").agg(F.sort_array(F.collect_list("to")).alias("neighbors"))
    empty = F.array().cast("array<long>")
    return numbered.join(pairs.withColumnRenamed("src", "id"), "id", "left").select("idx", "id", F.coalesce("neighbors", empty).alias("neighbors"))


def ordered(ids: DataFrame, column: str = "id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of ``column``, by range partitions and their sizes."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ids.select(column).distinct().repartitionByRange(parts, column).select(column, F.spark_partition_id().alias("_p")))
    first = ranged.groupBy("_p").count().withColumn("_first", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_first")
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(column)))
    return local.join(first, "_p").select(column, (F.col("_first") + F.col("_n") - 1).cast("long").alias("ord"))


def without_edges(net: Network) -> Network:
    """The vertices alone."""
    return Network(net.vertices, net.edges.limit(0))


def with_vertices(net: Network, ids: DataFrame) -> Network:
    """The given vertices (``id``) in place of the network's own, and no edge; what was there goes with its vertices."""
    return Network(ids.select("id").distinct(), net.edges.limit(0))


def renamed(net: Network, to: DataFrame) -> Network:
    """Other names for the vertices, by ``id, name``; edges stay between them.  Vertices that ``to`` lacks keep theirs."""
    told = lambda c: to.select(F.col("id").alias(c), F.col("name").alias(f"{c}_to"))
    v = net.vertices.join(to.select("id", "name"), "id", "left").select(F.coalesce("name", "id").alias("id")).distinct()
    e = net.edges.join(told("src"), "src", "left").join(told("dst"), "dst", "left")
    a, b = F.coalesce("src_to", "src"), F.coalesce("dst_to", "dst")
    return Network(v, e.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "w"))


#: Rounds in a row that find nothing to rewire.
IDLE = 5


def rewire(net: Network, share: float = 1.0, seed: int = 0) -> Network:
    """Degree-preserving random rewiring of ``share`` times as many pairs of edges as there are edges.

    Each round deals the edges into random pairs (a, b), (c, d) and turns a pair
    into (a, d), (c, b), weights carried, where all four ends differ and the new
    edges neither exist nor are proposed twice.  All pairs of a round are
    handled at once, so a round is a few joins whatever the size; the last one
    takes only as many as are wanted.  Rewiring ends early after IDLE rounds
    without any pair that can be turned, as in a complete network.
    """
    if not 0 <= share <= 1:
        raise ValueError("share lies in [0, 1]")
    edges = cut(net.edges)
    left, r, idle = int(share * edges.count()), -1, 0
    while left and idle < IDLE:
        r += 1
        dealt = gapless_rank(edges.withColumn("_k", F.lit(0)), ["_k"], [F.col("src"), F.col("dst"), F.lit(seed), F.lit(r)], "rank")
        side = dealt.withColumn("pair", F.floor(F.col("rank") / 2)).withColumn("second", F.col("rank") % 2 == 1)
        # a random end of the second edge comes first, else strings order the outcome
        turned = F.xxhash64("src", "dst", F.lit(seed + 1), F.lit(r)) % 2 == 0
        one = side.where(~F.col("second")).select("pair", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w1"))
        two = side.where("second").select("pair", F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("c"), F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("d"), F.col("w").alias("w2"))
        drawn = one.join(two, "pair").where("a <> c and a <> d and b <> c and b <> d")
        new = drawn.select("pair", F.explode(F.array(F.struct(F.least("a", "d").alias("src"), F.greatest("a", "d").alias("dst"), F.col("w1").alias("w")), F.struct(F.least("c", "b").alias("src"), F.greatest("c", "b").alias("dst"), F.col("w2").alias("w")))).alias("e")).select("pair", "e.*")
        new = cut(new)
        taken = new.join(edges.select("src", "dst"), ["src", "dst"], "left_semi").select("pair").union(new.groupBy("src", "dst").agg(F.count("*").alias("n"), F.collect_set("pair").alias("p")).where("n > 1").select(F.explode("p").alias("pair")))
        good = cut(drawn.join(taken.distinct(), "pair", "left_anti"))
        done = good.count()
        if done > left:
            # pairs were dealt at random, so the first ones are as random as any
            first = gapless_rank(good.select("pair").withColumn("_k", F.lit(0)), ["_k"], [F.col("pair")], "rank").where(F.col("rank") < left)
            good, done = cut(good.join(first.select("pair"), "pair", "left_semi")), left
        left, idle = left - done, 0 if done else idle + 1
        gone = good.select(F.explode(F.array(F.struct(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")), F.struct(F.least("c", "d").alias("src"), F.greatest("c", "d").alias("dst")))).alias("e")).select("e.*")
        edges = cut(edges.join(gone, ["src", "dst"], "left_anti").unionByName(new.join(good.select("pair"), "pair", "left_semi").select("src", "dst", "w")))
    return Network(net.vertices, edges)


def random_network(vertices: DataFrame, n_edges: int, seed: int = 0) -> Network:
    """G(n, M): exactly ``n_edges`` different pairs of the given vertices, weight 1.

    Pairs are drawn by hashes of their number with some to spare, so all pairs
    are never listed; the draws with the smallest numbers are kept.
    """
    spark = vertices.sparkSession
    numbered = cut(ordered(vertices))
    n = numbered.count()
    most = n * (n - 1) // 2
    if n_edges > most:
        raise ValueError(f"{n} vertices have {most} pairs, not {n_edges}")
    spare = 2 * n_edges + 100
    while True:
        draw = spark.range(spare).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("i"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(1)), F.lit(n)).alias("j")) if n else spark.range(0).select("id", F.col("id").alias("i"), F.col("id").alias("j"))
        pairs = cut(draw.where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("id").alias("turn")))
        if pairs.count() >= n_edges:
            break
        spare *= 2
    ranked = gapless_rank(pairs.withColumn("_k", F.lit(0)), ["_k"], [F.col("turn")], "rank").where(F.col("rank") < n_edges)
    a = numbered.select(F.col("ord").alias("i"), F.col("id").alias("a"))
    b = numbered.select(F.col("ord").alias("j"), F.col("id").alias("b"))
    return Network(vertices.select("id"), ranked.join(a, "i").join(b, "j").select(*canonical(F.col("a"), F.col("b")), F.lit(1.0).alias("w")))


def random_network_p(vertices: DataFrame, p: float, seed: int = 0) -> Network:
    """G(n, p): the number of edges is drawn first, then the edges."""
    import numpy as np

    n = vertices.count()
    return random_network(vertices, int(np.random.default_rng(seed).binomial(n * (n - 1) // 2, p)), seed)
