"""Sharding by a hierarchical weighted hash tree.

A topology is a list of regions, each a list of racks, each a list of shard
weights.  A key descends region, rack and shard; at each level every child
draws ``-ln(u) / weight`` with its own hash of key and node, and the smallest
draw wins.  A child's draw depends on nothing but itself, so changing a weight
moves keys only into or out of the subtree that holds it.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ranking import gapless_rank

Topology = list[list[list[float]]]


def topology(shards: int, regions: int = 2, racks: int = 3, per_rack: int = 4) -> Topology:
    """``regions x racks x per_rack`` shards of equal weight; each one beyond is a region of its own.

    A shard in a region of its own takes keys only into itself.  Put into an
    existing rack it would also attract keys to its neighbours.
    """
    base = regions * racks * per_rack
    if shards < base:
        raise ValueError(f"{shards} shards do not fill {regions} x {racks} x {per_rack}")
    return [[[1.0] * per_rack for _ in range(racks)] for _ in range(regions)] + [[[1.0]] for _ in range(shards - base)]


def _child(node: str, weight: float, at: int) -> Column:
    return F.struct(F.lit(node).alias("node"), F.lit(float(weight)).alias("weight"), F.lit(at).alias("at"))


def _winner(key: Column, children: Column) -> Column:
    """``at`` of the child with the smallest draw; on a tie the first one."""

    def draw(child: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(F.concat_ws("|", key, child["node"])), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(unit) / child["weight"]).alias("d"), child["at"].alias("at"))

    return F.array_min(F.transform(children, draw))["at"]


def assign(df: DataFrame, key: Column, tree: Topology, name: str = "shard") -> DataFrame:
    """Add ``name``, the number of the shard in reading order of ``tree``.

    Rows of one key go to one shard; a null key hashes as the empty string.
    The children of a node are looked up in a constant, so the code that is
    generated has one draw a level; one for each shard makes methods of 38,000
    bytes, which cost the compiler memory that no heap limit bounds.
    """
    text, rack_at, shard_at = F.coalesce(key.cast("string"), F.lit("")), count(), count()
    regions = F.array(*[_child(f"{i}", sum(map(sum, region)), i) for i, region in enumerate(tree)])
    racks = F.array(*[F.array(*[_child(f"{i}/{j}", sum(rack), next(rack_at)) for j, rack in enumerate(region)]) for i, region in enumerate(tree)])
    shards = F.array(*[F.array(*[_child(f"{i}/{j}/{k}", w, next(shard_at)) for k, w in enumerate(rack)]) for i, region in enumerate(tree) for j, rack in enumerate(region)])
    return df.withColumn(name, _winner(text, F.get(shards, _winner(text, F.get(racks, _winner(text, regions))))))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``law`` is ``key``: ``doc_id`` and the number of shards decide.  ``slot``
    numbers a shard's rows without gaps from 0; ``grown_shard`` is the shard
    with one more in the tree.  A null text has no bytes (size 8, crc 0); rows
    with equal ids share a shard and have slots of their own; a null id hashes
    as the empty string; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    placed = assign(assign(rows, F.col("doc_id"), topology(shards)), F.col("doc_id"), topology(shards + 1), "grown_shard")
    ranked = gapless_rank(placed, ["shard"], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
