"""Label propagation through a network: functional flow and a Gibbs-sampled random field.

Both keep their state as a keyed DataFrame.  Cross-validation folds and chains
are key columns, so that all of them run in the same jobs.

Arcs are dealt once, by a vertex cut: those of an ordinary vertex lie together,
those of a hub are dealt by their other ends, and what a step has to tell of
hubs goes out by broadcast.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.hubs import SHARE
from netloom.operators.network import Network, arcs, hub_ids, normalised
from netloom.operators.ranking import gapless_rank
from netloom.plans.session import cut, discard

#: Reservoirs closer than this exchange nothing.
EPSILON = 1e-8
CAPACITIES = ("raw", "out", "in")
#: Rows of hubs' state, folds times hubs, that go out by broadcast at most.
MOST_SENT = 1_000_000


@dataclass(frozen=True)
class Piece:
    """Arcs that lie together by ``src`` or ``dst``, and which ends of them are hubs."""

    arcs: DataFrame
    src_hub: bool
    dst_hub: bool


def vertex_cut(links: DataFrame, hubs: list[str], by: str = "src") -> list[Piece]:
    """``links`` dealt and kept: by ``by`` where that end is no hub, else by the other end, and by both where both are hubs."""
    other = "dst" if by == "src" else "src"
    if not hubs:
        return [Piece(links.repartition(by).persist(), False, False)]
    src, dst = F.col("src").isin(hubs), F.col("dst").isin(hubs)
    out = []
    for src_hub in (False, True):
        for dst_hub in (False, True):
            some = links.where((src if src_hub else ~src) & (dst if dst_hub else ~dst))
            own, far = (src_hub, dst_hub) if by == "src" else (dst_hub, src_hub)
            dealt = some.repartition(by) if not own else some.repartition(other) if not far else some.repartition("src", "dst")
            out.append(Piece(dealt.persist(), src_hub, dst_hub))
    return out


def _sent(state: DataFrame, end: str, hubs: list[str], hub: bool, fits: bool) -> DataFrame:
    """What is told of the vertices in ``end``: of hubs alone, by broadcast where it fits, or of all."""
    if not hub:
        return state
    told = state.where(F.col(end).isin(hubs))
    return F.broadcast(told) if fits else told


def functional_flow(net: Network, seeds: DataFrame, steps: int = 5, capacity: str = "raw", share: int = SHARE) -> DataFrame:
    """``id, score`` (and ``fold``, if ``seeds`` has one) after ``steps`` of functional flow.

    A seed's reservoir is infinite, all others start empty.  In each step an
    edge carries ``min(capacity, reservoir * w / sum of w)`` from its fuller end
    to the other, judged by the reservoirs before the step; the score is all
    that ever flowed into a vertex.  ``capacity``: the weight, or the weight
    over the sum at the giving (``out``) or the taking end (``in``).  Vertices
    without edges, and all vertices if no seed is in the network, score 0.

    The arcs are dealt once and stay there.  A step moves the state to them,
    the arcs of sources that hold something to their targets, and map-side
    combined sums to the vertices.  Vertices with over ``1 / share`` of the
    arcs are hubs: no step moves or gathers their arcs by them.
    """
    if capacity not in CAPACITIES:
        raise ValueError(f"capacity is one of {CAPACITIES}")
    keys = ["fold"] if "fold" in seeds.columns else []
    # in order, what is shuffled of the arcs and kept is a third in size
    net = Network(net.vertices, cut(net.edges.sortWithinPartitions("dst", "src")))
    hubs = hub_ids(net.edges, share)
    flows = normalised(net, hubs).select("src", "dst", "out_w", F.col({"raw": "w", "out": "out_w", "in": "in_w"}[capacity]).alias("cap"))
    pieces = vertex_cut(flows, hubs)
    folds = seeds.select(*keys).distinct() if keys else None
    fits = not hubs or folds is None or len(hubs) * folds.count() <= MOST_SENT
    everyone = net.vertices if folds is None else net.vertices.crossJoin(folds)
    marked = seeds.select(*keys, "id").distinct().withColumn("seed", F.lit(True))
    state = cut(everyone.join(marked, [*keys, "id"], "left").select(*keys, "id", F.when(F.col("seed"), F.lit(float("inf"))).otherwise(0.0).alias("r"), F.lit(0.0).alias("score")))
    for _ in range(steps):
        giving = state.where("r > 0").select(*keys, F.col("id").alias("src"), F.col("r").alias("r_src"))
        taking = state.select(*keys, F.col("id").alias("dst"), F.col("r").alias("r_dst"))
        change = None
        for piece in pieces:
            met = piece.arcs.join(_sent(giving, "src", hubs, piece.src_hub, fits), "src").join(_sent(taking, "dst", hubs, piece.dst_hub, fits), [*keys, "dst"])
            moved = met.where((F.col("r_src") > F.col("r_dst")) & (F.col("r_src") - F.col("r_dst") >= EPSILON)).withColumn("flow", F.least("cap", F.col("r_src") * F.col("out_w")))
            both = F.array(F.struct(F.col("dst").alias("id"), F.col("flow").alias("net"), F.col("flow").alias("got")), F.struct(F.col("src").alias("id"), (-F.col("flow")).alias("net"), F.lit(0.0).alias("got")))
            part = moved.select(*keys, F.explode(both).alias("c")).select(*keys, "c.*")
            change = part if change is None else change.union(part)
        change = change.groupBy(*keys, "id").agg(F.sum("net").alias("net"), F.sum("got").alias("got"))
        after = state.join(change, [*keys, "id"], "left").select(*keys, "id", (F.col("r") + F.coalesce("net", F.lit(0.0))).alias("r"), (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("score"))
        old, state = state, cut(after)
        discard(old)
    for piece in pieces:
        piece.arcs.unpersist()
    discard(net.edges)
    return state.select(*keys, "id", "score")


def normalise(scores: DataFrame) -> DataFrame:
    """Divide by the largest score, if that is positive."""
    top = scores.agg(F.max("score").alias("top"))
    return scores.join(F.broadcast(top)).withColumn("score", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score"))).drop("top")


def one_time(scores: DataFrame, genes: DataFrame) -> DataFrame:
    """``id, label, score`` of listed genes with a positive score, after normalising over all vertices; positives score 1."""
    listed = genes.select("id", "label").join(normalise(scores), "id", "left")
    return listed.withColumn("score", F.when(F.col("label"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))).where("score > 0")


def folds_by_hash(items: DataFrame, strata: list[str], folds: int, seed: int = 0) -> DataFrame:
    """Add ``fold``, 0 to ``folds - 1``, with sizes that differ by at most one in each stratum."""
    keyed = items.withColumn("_s", F.xxhash64(*strata) if strata else F.lit(0).cast("long"))
    return gapless_rank(keyed, ["_s"], [F.col("id"), F.lit(seed)], "_r").withColumn("fold", (F.col("_r") % folds).cast("int")).drop("_s", "_r")


def cross_validated(net: Network, genes: DataFrame, steps: int = 5, capacity: str = "raw") -> DataFrame:
    """``id, label, fold, score`` of listed genes, each scored from the positives of all other folds.

    ``genes`` has ``id, label, fold``.  Scores are pooled and normalised once;
    positives are not raised to 1.
    """
    folds = genes.select(F.col("fold").alias("held")).distinct()
    seeds = genes.where("label").select("id", F.col("fold").alias("own")).join(folds, F.col("own") != F.col("held")).select("id", F.col("held").alias("fold"))
    scores = functional_flow(net, seeds, steps, capacity)
    return normalise(genes.select("id", "label", "fold").join(scores, ["id", "fold"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))))


def shuffle_labels(genes: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Swap the labels of about ``share`` of the positives, one at least, with as many others.

    Never more swaps than there are unknowns.
    """
    ranked = cut(gapless_rank(genes.withColumn("_label", F.coalesce(F.col("label"), F.lit(False))), ["_label"], [F.col("id"), F.lit(seed)], "_r"))
    size = ranked.agg(F.sum(F.col("_label").cast("long")).alias("p"), F.sum((~F.col("_label")).cast("long")).alias("u"))
    swaps = F.when(F.lit(share) > 0, F.least(F.greatest(F.lit(1), F.floor(F.lit(share) * F.coalesce("p", F.lit(0)))), F.coalesce("p", F.lit(0)), F.coalesce("u", F.lit(0)))).otherwise(0)
    joined = ranked.join(F.broadcast(size.select(swaps.alias("swaps"))))
    return joined.withColumn("label", F.when(F.col("_r") < F.col("swaps"), ~F.col("_label")).otherwise(F.col("_label"))).drop("_label", "_r", "swaps")


def _unit(*of: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") + 0.5) / float(1 << 53)


#: Samples between which so many sweeps lie when burn-in and sweeps are given.
LAG = 10
#: By rule: sweeps of the first phase, twice as many in each further one, of all phases at most; how far chains may
#: disagree (potential scale reduction) at so many of the vertices; and effective samples, over all vertices.
FIRST_PHASE, MOST_SWEEPS, REDUCTION, SETTLED, EFFECTIVE = 10, 2560, 1.1, 0.95, 200


def _packs(chains: int, width: int) -> list[list[int]]:
    """Chains whose counts lie in one number, each in ``width`` bits."""
    each = 63 // width
    return [list(range(k, min(k + each, chains))) for k in range(0, chains, each)]


def _heard(pieces: list[Piece], hubs: list[str], told: DataFrame) -> DataFrame:
    """``id`` and the sums of what ``told`` (``dst`` and others) tells the other ends of its arcs."""
    columns, near = [c for c in told.columns if c != "dst"], None
    for piece in pieces:
        # hashed, as sorting the arcs again for each sweep would take most of its time
        sent = told.hint("shuffle_hash") if not piece.dst_hub else _sent(told, "dst", hubs, True, True)
        part = piece.arcs.join(sent, "dst").select("src", *columns)
        near = part if near is None else near.union(part)
    return near.groupBy(F.col("src").alias("id")).agg(*[F.sum(c).alias(c) for c in columns])


def _sweep(pieces: list[Piece], hubs: list[str], state: DataFrame, chains: int, width: int, law: tuple[float, float, float], seed: int, more: list[str]) -> DataFrame:
    """One synchronous draw of all chains, with the columns ``more``; no vertex has ``m`` of over ``width`` bits."""
    alpha, beta, gamma = law
    packs = _packs(chains, width)
    ones = [" + ".join(f"shiftleft(CAST(x{k} AS BIGINT), {width * i})" for i, k in enumerate(pack)) + f" AS p{j}" for j, pack in enumerate(packs)]
    near = _heard(pieces, hubs, state.selectExpr("id AS dst", *ones))
    told = {k: f"(shiftright(coalesce(p{j}, 0L), {width * i}) & {(1 << width) - 1}L)" for j, pack in enumerate(packs) for i, k in enumerate(pack)}
    unit = lambda k: f"(shiftrightunsigned(xxhash64({k}, id, {seed}, t), 11) + 0.5D) / {float(1 << 53)!r}D"
    z = lambda k: f"{alpha!r}D + {beta - 1!r}D * (m - {told[k]}) + {gamma - beta!r}D * {told[k]}"
    drawn = [f"CASE WHEN seed OR {unit(k)} < 1 / (1 + exp(-({z(k)}))) THEN 1 ELSE 0 END AS x{k}" for k in range(chains)]
    return state.join(near, "id", "left").selectExpr("id", "seed", "m", "t + 1 AS t", *drawn, *more)


def agreement(state: DataFrame, chains: int, half: int) -> tuple[float, float]:
    """Of counts ``a0, b0, a1, ..`` of ones in two halves of each chain: the share of vertices where these agree, and effective samples.

    The halves' means vary between chains by what a sample is worth: their
    variance over that of a single draw is the share of a draw that
    each half's mean is as uncertain as, so ``2 chains`` over that ratio, pooled
    over all vertices, counts independent samples.
    """
    means = F.array(*[F.col(f"{h}{k}") / F.lit(float(half)) for k in range(chains) for h in "ab"])
    n = 2 * chains
    total = F.aggregate("means", F.lit(0.0), lambda s, v: s + v)
    spread = state.where("not seed").select(means.alias("means")).select("means", (total / n).alias("p"))
    between = F.aggregate("means", F.lit(0.0), lambda s, v: s + v * v)
    spread = spread.select((F.col("p") * (1 - F.col("p"))).alias("w"), F.greatest(F.lit(0.0), (between - n * F.col("p") * F.col("p")) / (n - 1)).alias("b"))
    fits = F.col("w") * (1 - 1 / half) + F.col("b") <= REDUCTION**2 * F.col("w") + 1e-12
    told = spread.agg(F.avg(fits.cast("double")).alias("settled"), F.sum("w").alias("w"), F.sum("b").alias("b")).first()
    if told["settled"] is None or not told["w"]:
        return 1.0, float("inf")
    return told["settled"], n * told["w"] / told["b"] if told["b"] else float("inf")


def random_field(net: Network, seeds: DataFrame, alpha: float = 0.0, beta: float = 0.0, gamma: float = 0.0, prior: float | None = None, burn_in: int | None = None, sweeps: int | None = None, lag: int = LAG, chains: int = 16, seed: int = 0, share: int = SHARE) -> DataFrame:
    """``id, score``: the share of sampled states 1 in a Markov random field.

    Synchronous Gibbs sampling: ``P(1) = sigmoid(alpha + (beta - 1) * m0 +
    (gamma - beta) * m1)`` with ``m0`` and ``m1`` neighbours in state 0 and 1;
    seeds in the network stay 1.

    Burn-in and sampling end by rule.  Chains start far apart, with shares of
    ones from none to all, and run in phases that double in length.  A phase
    whose halves agree between all chains at nearly all vertices (potential
    scale reduction of 1.1 or less) and are worth EFFECTIVE independent samples
    is the sample; what was before it, half of all sweeps, is burn-in.  Where
    chains never agree, the last phase within MOST_SWEEPS is taken, with a
    warning.  With ``burn_in`` and ``sweeps`` given the chains start by ``prior``, by default the share of
    seeds, and each ``lag``-th sweep after ``burn_in`` is a sample.

    A vertex is one row with a column per chain: a sweep is
    one join and one sum for all chains, several of which share a number, as no
    count is larger than the largest degree, and the arcs stay where the vertex
    cut dealt them.  Draws are hashes of chain, sweep and vertex.
    """
    if (burn_in is None) != (sweeps is None):
        raise ValueError("burn_in and sweeps are given together or not at all")
    x = [f"x{k}" for k in range(chains)]
    edges = cut(net.edges.select("src", "dst", "w").sortWithinPartitions("dst", "src"))
    hubs = hub_ids(edges, share)
    pieces = vertex_cut(arcs(edges).select("src", "dst"), hubs, by="dst")
    marked = net.vertices.join(seeds.select("id").distinct().withColumn("seed", F.lit(True)), "id", "left").select("id", F.coalesce("seed", F.lit(False)).alias("seed"))
    degree = _heard(pieces, hubs, net.vertices.select(F.col("id").alias("dst"), F.lit(1).cast("long").alias("m")))
    marked = cut(marked.join(degree, "id", "left").select("id", "seed", F.coalesce("m", F.lit(0)).alias("m")))
    width = max(1, (marked.agg(F.max("m")).first()[0] or 0).bit_length())
    fixed = F.lit(prior) if prior is not None else F.avg(F.col("seed").cast("double"))
    start = marked.join(F.broadcast(marked.agg(fixed.alias("pi"))))
    ones = lambda k: F.col("pi") if burn_in is not None else F.lit(k / max(1, chains - 1))
    first = [F.when(F.col("seed") | (_unit(F.lit(k), F.col("id"), F.lit(seed)) < ones(k)), 1).otherwise(0).alias(x[k]) for k in range(chains)]
    halves = [f"{h}{k}" for k in range(chains) for h in "ab"]
    # the sweep's number is a column, so that every sweep runs the code compiled for the first
    state = cut(start.select("id", "seed", "m", F.lit(1).alias("t"), *first, *[F.lit(0).cast("long").alias(c) for c in ([] if burn_in is not None else halves)], F.lit(0).cast("long").alias("hits")))
    law = (alpha, beta, gamma)

    def step(before: DataFrame, more: list[str], then: list) -> DataFrame:
        after = cut(_sweep(pieces, hubs, before, chains, width, law, seed, more).select("id", "seed", "m", "t", *x, *then))
        discard(before)
        return after

    if burn_in is not None:
        kept = 0
        for t in range(1, burn_in + sweeps + 1):
            sampled = t > burn_in and (t - burn_in) % lag == 0
            kept += sampled
            hits = sum((F.col(c) for c in x), F.lit(0)) if sampled else F.lit(0)
            state = step(state, ["hits"], [(F.col("hits") + hits).alias("hits")])
        draws = kept * chains
    else:
        length, done = FIRST_PHASE, 0
        while True:
            for t in range(length):
                # the halves of a phase start from nothing
                old = (lambda c: F.lit(0).cast("long")) if t == 0 else F.col
                now = "a" if 2 * t < length else "b"
                state = step(state, halves, [(old(c) + F.col(f"x{c[1:]}") if c[0] == now else old(c)).cast("long").alias(c) for c in halves])
            done += length
            settled, effective = agreement(state, chains, length // 2)
            if settled >= SETTLED and effective >= EFFECTIVE:
                break
            if done + 2 * length > MOST_SWEEPS:
                warnings.warn(f"chains disagree after {done} sweeps: {settled:.3f} of the vertices settled, {effective:.0f} effective samples", stacklevel=2)
                break
            length *= 2
        state = state.withColumn("hits", sum((F.col(c) for c in halves), F.lit(0)))
        draws = length * chains
    for piece in pieces:
        piece.arcs.unpersist()
    return state.select("id", (F.col("hits") / F.lit(float(max(1, draws)))).alias("score"))
