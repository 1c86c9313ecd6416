"""Merkle manifest of a dataset: one binary tree for each language and one over their roots.

Leaves are numbered within their tree by ranges, so no task sees a whole
language.  A superblock is a run of ``2 ** LEVELS`` leaves.  Going up, each
superblock is reduced to one node, and so are superblocks of these nodes, until
every tree has one.  Going down, the leaves of a superblock and the outer nodes
that their proofs need are cogrouped: one task finishes the local reduction,
joins local and outer proof, and folds both to the root.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ranking import ordered_rank
from netloom.plans.session import cut

#: Levels of a tree inside one superblock.
LEVELS = 10


def digest(*of: str) -> str:
    return hashlib.sha256("".join(of).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each written as its number of UTF-8 bytes, a colon and itself, or as a hyphen if null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]), 256)


def reduce_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and those of ``levels`` levels above; a node without a partner is hashed alone."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def height(total: int, levels: int) -> int:
    """How many levels of a tree that is ``total`` nodes wide here lie inside a superblock."""
    return min(levels, max(0, int(total) - 1).bit_length())


def fold(node: str, siblings: list[str], sides: str) -> str:
    """The root that a node and its siblings give; ``sides``: ``l`` or ``r`` where the sibling stands there, ``-`` where there is none."""
    at = iter(siblings)
    for side in sides:
        node = digest(next(at), node) if side == "l" else digest(node, next(at)) if side == "r" else digest(node)
    return node


def _block(levels: int) -> Column:
    return F.shiftright("at", levels).alias("block")


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """``tree, at, total, node`` of the nodes given and of every ``levels`` levels above, up to one node for each tree."""

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        total = int(pdf["total"].iloc[0])
        top = reduce_levels(pdf["node"].tolist(), height(total, levels))[-1][0]
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "at": [int(pdf["at"].iloc[0]) >> levels], "total": [((total - 1) >> levels) + 1], "node": [top]})

    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        below = out[-1].select("tree", "at", "total", "node")
        out.append(cut(below.groupBy("tree", _block(levels)).applyInPandas(up, "tree string, at long, total long, node string")))
    return out


def descend(nodes: DataFrame, outer: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` with ``proof``, ``sides``, ``root`` and ``folded``: the siblings of each from its place up to the root of roots.

    ``outer`` (``tree, at, proof, sides, subroot, root``) tells the same of the
    node that each superblock of ``nodes`` comes to.  ``folded`` is the root
    that comes of ``now`` and those siblings, or of ``node`` where it is null.
    """

    def finish(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at").reset_index(drop=True)
        lead = above.iloc[0]
        outer_proof, outer_sides = list(lead["proof"]), lead["sides"]
        rows = reduce_levels(pdf["node"].tolist(), height(pdf["total"].iloc[0], levels))[:-1]
        seen: dict[str, str] = {}
        proofs, sides, folded = [], [], []
        for i, (node, now) in enumerate(zip(pdf["node"], pdf["now"], strict=True)):
            own, where = [], []
            for k, row in enumerate(rows):
                other = (i >> k) ^ 1
                if other < len(row):
                    own.append(row[other])
                where.append("-" if other >= len(row) else "l" if (i >> k) & 1 else "r")
            local = fold(node if now is None or now != now else now, own, "".join(where))
            if local not in seen:
                seen[local] = fold(local, outer_proof, outer_sides)
            proofs.append(own + outer_proof)
            sides.append("".join(where) + outer_sides)
            folded.append(seen[local])
        return pdf.drop(columns="block").assign(proof=proofs, sides=sides, subroot=lead["subroot"], root=lead["root"], folded=folded)

    plain = nodes if "now" in nodes.columns else nodes.withColumn("now", F.lit(None).cast("string"))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in plain.dtypes)
    inner = plain.withColumn("block", _block(levels)).groupBy("tree", "block")
    lead = outer.select("tree", F.col("at").alias("block"), "proof", "sides", "subroot", "root").groupBy("tree", "block")
    return inner.cogroup(lead).applyInPandas(finish, f"{kinds}, proof array<string>, sides string, subroot string, root string, folded string")


def _descended(tree: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """The lowest nodes of a tree with their proofs, from the proof of its top."""
    for nodes in reversed(tree[1:-1]):
        outer = cut(descend(nodes, outer, levels))
    return descend(tree[0], outer, levels)


def manifest(docs: DataFrame, now: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, sides, folded_root, verified`` for every row of ``docs``.

    A leaf is the digest of ``doc_id, source, lang, n_chars, text``.  Leaves of
    one ``lang`` ascend by ``doc_id``; every two neighbours become one node
    until ``subroot`` is left, which is the leaf itself if it is alone; the
    subroots, null ``lang`` first and then bytewise, become ``root`` likewise.
    ``proof`` lists the siblings on the way to ``root`` and ``sides`` where
    each stands.  ``now`` tells which columns hold another value today:
    ``folded_root`` is what the row of today and its siblings come to, and
    ``verified`` whether that is ``root``.

    Null values have a digest of their own; rows with equal ids are ordered by
    their leaves and equal rows by chance, as they are alike; a null id comes
    first; null and empty ``lang`` are two trees; other columns are ignored; an
    empty table gives an empty result.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    then = [F.col(c) for c in fields]
    today = [(now or {}).get(c, F.col(c)) for c in fields]
    changed = F.lit(False)
    for a, b in zip(then, today, strict=True):
        changed = changed | ~a.eqNullSafe(b)
    # a prefix keeps the order and tells null from empty
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree")
    told = docs.select("doc_id", tree, leaf_digest(then).alias("node"), (F.when(changed, leaf_digest(today)) if now else F.lit(None).cast("string")).alias("now"))
    # ids travel as text, as pandas has no null among integers
    leaves = ordered_rank(told, "tree", ["doc_id", "node"]).withColumn("doc_id", F.col("doc_id").cast("string"))
    trees = climb(leaves, levels)
    tops = cut(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"))
    over = climb(ordered_rank(tops, "tree", ["of"]), levels)
    nothing = F.lit(None).cast("string")
    lead = over[-1].select("tree", "at", F.array().cast("array<string>").alias("proof"), F.lit("").alias("sides"), nothing.alias("subroot"), F.col("node").alias("root"))
    tops = _descended(over, lead, levels).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), "proof", "sides", F.col("node").alias("subroot"), "root")
    proved = _descended(trees, cut(tops), levels)
    kind = dict(docs.dtypes)["doc_id"]
    return proved.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", "proof", "sides", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def verify(rows: DataFrame) -> DataFrame:
    """``rows`` (``leaf, proof, sides, root``) with ``holds``: whether the proof of each leads to its root, told row by row without the dataset."""

    @F.pandas_udf("boolean")
    def holds(leaf: pd.Series, proof: pd.Series, sides: pd.Series, root: pd.Series) -> pd.Series:
        return pd.Series([fold(a, list(p), s) == r for a, p, s, r in zip(leaf, proof, sides, root, strict=True)], dtype=bool)

    return rows.withColumn("holds", holds("leaf", "proof", "sides", "root"))
