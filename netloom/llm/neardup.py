"""Near-duplicate documents: SimHash fingerprints and binary-trie self-joins.

Fingerprints are grouped first, so copies cost nothing further.  The distinct
ones are put into binary tries and each trie is joined with itself: node pairs
descend together, the bits in which their paths differ add up, and a pair is
dropped as soon as that sum exceeds the radius.

To spread the work, the 64 bits are cut into ``radius + 2`` blocks.  Two
fingerprints within the radius differ in at most ``radius`` of them, so two
whole blocks agree.  For each choice of two blocks there is a trie that reads
these first: above that depth only a node paired with itself survives, and the
subtrees below are independent pieces of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.textops import sliced
from netloom.operators.components import connected_components
from netloom.operators.hubs import join_by_key, needed
from netloom.plans.session import cut

WORDS, SEED, RADIUS = 3, 42, 2
#: A subtree with more fingerprints than this is cut into node pairs further down.
LEAVES = 1 << 16
#: How many bits further down.
STEP = 12
#: A task is one subtree of a trie, or a pair of them.
TASK = ("trie", "x", "y")


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit integer."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    whole = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[words - 1 :].tolist() if len(w) >= words else [len(whole)]
    of = xxhash.xxh64_intdigest
    h = np.array([of(whole[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    return int(majority(h).view(np.int64))


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half the values.

    Eight bits, eight apart, are counted per addition: each byte of a sum of up
    to 255 masked values is one counter.
    """
    lanes, out = np.uint64(0x0101010101010101), np.uint64(0)
    cuts = np.arange(0, len(h), 255)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & lanes, cuts)
        counts = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        bits = np.packbits(np.pad((2 * counts > len(h))[:, None], ((0, 0), (0, 7))), axis=1, bitorder="little").ravel().view(np.uint64)[0]
        out |= bits << np.uint64(k)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, also: list[Column] | None = None) -> DataFrame:
    """``doc_id, fp`` for every row, and columns ``also`` as ``c0`` ..; a text without words, null included, has fingerprint 0."""
    more = [c.alias(f"c{i}") for i, c in enumerate(also or [])]
    asked = docs.select("doc_id", "text", *more)
    names = ["doc_id", "fp", *asked.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fp = [fingerprint(t or b"", words, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), *batch.columns[2:]], names)

    return asked.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} {kind}" for c, kind in asked.dtypes[2:]))


def _orders(radius: int) -> list[list[tuple[int, int]]]:
    """For each trie, the (first bit, number of bits) of the blocks in the order it reads them."""
    n = radius + 2
    ends = [64 * i // n for i in range(n + 1)]
    block = [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
    return [[block[i] for i in c] + [block[i] for i in range(n) if i not in c] for c in combinations(range(n), 2)]


def _turned(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` as a trie reads them, the first ones highest."""
    out, at = F.lit(0).cast("long"), 64
    for first, n in order:
        at -= n
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1)), at))
    return out


def descend(a: np.ndarray, b: np.ndarray, top: int, spent: np.ndarray, radius: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join subtrees: indices into ``codes`` of the pairs of leaves within ``radius``.

    ``a`` and ``b`` are (n, 2) ranges of ``codes``, sorted inside each range,
    whose leaves agree above bit ``top`` in each range; ``spent`` are the bits
    in which the two paths differ so far.  All node pairs of one depth are
    handled at once.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(top - 1, -1, -1):
        size_a, size_b = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
        same = a[:, 0] == b[:, 0]
        keep = (size_a > 0) & (size_b > 0) & ~(same & (size_a < 2)) & (spent <= radius)
        single = keep & (size_a == 1) & (size_b == 1)
        if single.any():
            i, j = a[single, 0], b[single, 0]
            below = np.uint64((1 << (bit + 1)) - 1)
            near = spent[single] + np.bitwise_count((codes[i] ^ codes[j]) & below) <= radius
            found.append((i[near], j[near]))
        keep &= ~single
        a, b, spent, same = a[keep], b[keep], spent[keep], same[keep]
        if not len(a):
            break
        ones = np.concatenate(([0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        cut_a = a[:, 1] - (ones[a[:, 1]] - ones[a[:, 0]])
        cut_b = b[:, 1] - (ones[b[:, 1]] - ones[b[:, 0]])
        a0, a1 = np.column_stack((a[:, 0], cut_a)), np.column_stack((cut_a, a[:, 1]))
        b0, b1 = np.column_stack((b[:, 0], cut_b)), np.column_stack((cut_b, b[:, 1]))
        cross = ~same
        a = np.concatenate((a0, a1, a0, a1[cross]))
        b = np.concatenate((b0, b1, b1, b0[cross]))
        spent = np.concatenate((spent, spent, spent + 1, spent[cross] + 1))
    else:
        size_a, size_b = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
        keep = (size_a == 1) & (size_b == 1) & (a[:, 0] != b[:, 0]) & (spent <= radius)
        found.append((a[keep, 0], b[keep, 0]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest one it is connected to by the links."""
    low = np.arange(n)
    while len(i):
        m = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def _join_tasks(radius: int, depth: list[int]):
    """Join the subtrees of each task; rows come sorted by task, side and code.

    A pair (fingerprint, root of its links) is returned for each leaf that has
    a link: as many rows as leaves at most, whatever the number of links.
    """

    def changes(table: pa.Table) -> np.ndarray:
        """For each row but the first, whether another task begins."""
        columns = [table.column(c).to_numpy() for c in TASK]
        return np.logical_or.reduce([c[1:] != c[:-1] for c in columns])

    def work(table: pa.Table) -> pa.RecordBatch:
        side = table.column("side").to_numpy()
        codes = table.column("code").to_numpy().view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], changes(table) | (side[1:] != side[:-1]))))
        last = np.append(first[1:], len(side))
        ranges = np.column_stack((first, last))
        two = np.flatnonzero(side[first] == 1)
        own = np.setdiff1d(np.arange(len(first)), np.concatenate((two, two - 1)))
        spent = table.column("spent").to_numpy()[first]
        tops = table.column("top").to_numpy()[first]
        links = []
        for top in np.unique(tops):
            t, o = two[tops[two] == top], own[tops[own] == top]
            a = np.concatenate((ranges[o], ranges[t - 1]))
            b = np.concatenate((ranges[o], ranges[t]))
            links.append(descend(a, b, int(top), np.concatenate((spent[o], spent[t])).astype(np.int64), radius, codes))
        i, j = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])
        low = _stars(i, j, len(side))
        moved = np.flatnonzero(low != np.arange(len(side)))
        fp = table.column("fp").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[low[moved]])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            ends = np.flatnonzero(changes(held))
            if len(ends):
                whole = int(ends[-1]) + 1
                yield work(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield work(held.combine_chunks())

    return run


def trie_self_join(distinct: DataFrame, radius: int = RADIUS, leaves: int = LEAVES) -> DataFrame:
    """``(src, dst)`` links that connect all values of column ``fp`` within ``radius`` bits.

    ``distinct`` holds each fingerprint once.  The links have the components of
    all pairs within the radius; a task hands over a star per component it
    sees, not its pairs.  A subtree of at most ``leaves`` fingerprints is one
    task; a larger one is cut ``STEP`` bits further down into pairs of nodes
    whose paths differ in at most ``radius`` bits, found by an equi-join on the
    node's own bits changed in 0, 1, .. ``radius`` places.
    """
    orders = _orders(radius)
    depth = [o[0][1] + o[1][1] for o in orders]
    tries = F.array(*[F.struct(F.lit(t).alias("trie"), _turned(F.col("fp"), o).alias("code"), F.lit(64 - depth[t]).alias("top")) for t, o in enumerate(orders)])
    leaf = distinct.select("fp", F.explode(tries).alias("x")).select("fp", "x.*")
    leaf = leaf.withColumn("node", F.expr("shiftrightunsigned(code, top)"))
    sized = leaf.groupBy("trie", "node").count().where("count > 1")
    leaf = cut(leaf.join(sized, ["trie", "node"]))
    small = leaf.where(F.col("count") <= leaves).select("trie", F.col("node").alias("x"), F.lit(-1).cast("long").alias("y"), F.lit(0).alias("side"), F.lit(0).alias("spent"), "top", "code", "fp")
    big = leaf.where(F.col("count") > leaves)
    work = small
    if not big.isEmpty():
        step = F.lit(STEP)
        big = big.withColumn("low_top", F.col("top") - step).withColumn("child", F.expr("shiftrightunsigned(code, low_top)"))
        children = big.select("trie", "node", "child").distinct()
        flips = [0] + [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(STEP), r)]
        turned = children.withColumn("other", F.explode(F.array(*[F.col("child").bitwiseXOR(F.lit(f)) for f in flips]))).where("child <= other")
        there = children.select("trie", F.col("child").alias("other"))
        pair = turned.join(there, ["trie", "other"]).withColumn("spent", F.bit_count(F.col("child").bitwiseXOR(F.col("other"))))
        ends = F.when(F.col("child") == F.col("other"), F.array(F.struct(F.lit(0).alias("side"), F.col("child").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("child").alias("at")), F.struct(F.lit(1).alias("side"), F.col("other").alias("at"))))
        tagged = pair.select("trie", F.col("child").alias("x"), F.col("other").alias("y"), "spent", F.explode(ends).alias("e")).select("trie", "x", "y", "spent", "e.side", F.col("e.at").alias("child"))
        deep = tagged.join(big.select("trie", "child", "low_top", "code", "fp"), ["trie", "child"])
        work = small.unionByName(deep.select(*TASK, "side", "spent", F.col("low_top").alias("top"), "code", "fp"))
    dealt = work.repartition(*TASK).sortWithinPartitions(*TASK, "side", "code").select(*TASK, F.col("side").cast("int"), F.col("spent").cast("int"), F.col("top").cast("int"), "code", "fp")
    return dealt.mapInArrow(_join_tasks(radius, depth), "src long, dst long").distinct()


def components_of(marked: DataFrame, radius: int) -> DataFrame:
    """``fp, n, low, component``: how many rows of ``marked`` (``doc_id, fp``) have a fingerprint, their smallest id, and its group."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    component = connected_components(trie_self_join(distinct, radius)).select(F.col("id").alias("fp"), "component")
    return distinct.join(component, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Rows are linked when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest ``doc_id`` of the connected group, the
    row's own if it is alone.  Texts without words, null included, share
    fingerprint 0 and so one group.  Rows with equal ids stay rows of their
    own; a null ``doc_id`` keeps its row and never names a group that has an
    id; other columns are ignored; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, words))
    grouped = components_of(marked, radius)
    grouped = cut(grouped)
    named = grouped.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("kinds"))
    group = join_by_key(grouped.select("fp", "n", "component"), named, ["component"], "kinds", grouped.count()).select("fp", "n", "component_id")
    told = join_by_key(marked, group, ["fp"], "n", marked.count())
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group does: the one with the smallest id, then the smallest text hash.

    Rows are told by id and text, so unlinked texts that share an id, or have
    none, all stay; a row without an id stands for a group only where no row
    has one.  Of rows with equal id and text one stays, the smallest by all its
    columns.  Texts are shuffled only for rows that share an id with one that
    goes.
    """
    body = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    marked = cut(fingerprints(docs, words, also=[body]).withColumnRenamed("c0", "body"))
    total = marked.count()
    group = components_of(marked, radius).select("fp", "n", "component")
    rows = cut(join_by_key(marked, group, ["fp"], "n", total).select("component", F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "body").alias("row")))
    best = rows.groupBy("component").agg(F.min("row").alias("best"), F.count("*").alias("n")).where("n > 1")
    judged = join_by_key(rows, best, ["component"], "n", total)
    goes = cut(judged.groupBy("row").agg(F.count("*").alias("copies"), F.max((F.col("row") == F.col("best")).cast("int")).alias("stays")).where("stays = 0 or copies > 1").select("row.doc_id", "row.body", "stays"))
    touched, untouched = needed(docs, F.col("doc_id"), goes.select("doc_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = touched.select(F.struct(*columns).alias("row"), F.struct(F.col("doc_id").alias("id"), body.alias("body")).alias("key"))
    told = goes.select(F.struct(F.col("doc_id").alias("id"), "body").alias("key"), "stays")
    free = packed.join(told, packed["key"].eqNullSafe(told["key"]), "left_anti").select("row.*")
    one = packed.join(told.where("stays = 1").withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of"))).groupBy("key").agg(F.min("row").alias("row")).select("row.*")
    return untouched.union(free).union(one)
