"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.hubs import join_by_key
from netloom.plans.session import cut, discard


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang each larger neighbour of a node on the smallest node around it."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"), F.count("*").alias("n"))
    return join_by_key(both.where("dst > src"), least, ["src"], "n", 2 * total).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src > dst").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang the smaller neighbours of a node, and the node, on the smallest of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n"))
    moved = join_by_key(edges, least, ["src"], "n", total).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src > dst")
    return moved.union(least.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node that an edge names; ``component`` is its smallest id.

    ``edges`` has two columns of one ordered type.  Rows with a null end are
    dropped; a self-loop only registers its node.  Each round is two joins and
    two map-side combined minima; the number of rounds is logarithmic in the
    size of a component, chains included.  No group is ever collected: a hub's
    edges stay where they are and get its least neighbour by broadcast.
    """
    a, b = edges.columns[:2]
    named = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    current = cut(named.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    loops = current.where("src = dst").select("src")
    print_of = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")))
    links = current.where("src > dst")
    before, total = None, links.count()
    for _ in range(max_rounds if total else 0):
        hung = cut(_large_star(links, total))
        old, links = links, cut(_small_star(hung, total))
        discard(old, hung)
        now = links.agg(print_of.alias("p")).first()["p"]
        if now == before:
            break
        before, total = now, now["n"]
    else:
        if total:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    member = links.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    roots = links.select("dst").distinct().select(F.col("dst").alias("id"), F.col("dst").alias("component"))
    lone = loops.join(member.select(F.col("id").alias("src")), "src", "left_anti").join(roots.select(F.col("id").alias("src")), "src", "left_anti")
    return member.union(roots).union(lone.select(F.col("src").alias("id"), F.col("src").alias("component")))
