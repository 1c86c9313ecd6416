"""Bagged neural networks trained by summed gradients, and vector quantisation.

All members of an ensemble train at once: an epoch is one job in which every
partition sums the gradients of its rows for every member, a few tasks add the
partitions' sums, and the driver, which holds nothing but weights, steps.  A
row's part in a member's bootstrap sample is a Poisson count drawn from a hash
of row and member, so no bag is ever stored.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions.stats import student_p
from netloom.operators import ontology
from netloom.operators.ranking import ordered_rank
from netloom.plans.session import cut

ADDERS = 8
Array = np.ndarray


@dataclass(frozen=True)
class Activation:
    f: Callable[[Array], Array]
    slope: Callable[[Array], Array]
    """Derivative as a function of the output."""


ACTIVATIONS = {
    "sigmoid": Activation(lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
    "tanh": Activation(np.tanh, lambda a: 1 - a * a),
    "tansig": Activation(lambda z: 2 / (1 + np.exp(-2 * np.clip(z, -250, 250))) - 1, lambda a: 1 - a * a),
    "purelin": Activation(lambda z: z, np.ones_like),
}


def _through(a: Array | None, f: Array, scale: bool) -> Array:
    return f if a is None else f @ a.T / (a.shape[0] if scale else 1)


def _distance(f: Array, y: Array, a: Array) -> tuple[Array, Array]:
    m = a.shape[0]
    gap = _through(a, f, True) - y
    up, down = np.where(gap > 0, gap, 0).sum(1), np.where(gap < 0, gap, 0).sum(1)
    d = np.sqrt(up**2 + down**2)
    slope = np.where(gap > 0, up[:, None], np.where(gap < 0, down[:, None], 0)) / np.maximum(d, 1e-12)[:, None]
    return d, slope @ a / m


def loss(name: str, f: Array, y: Array, a: Array | None = None) -> tuple[Array, Array]:
    """(loss of each row, gradient by prediction).

    ``a`` is the ancestor matrix of the outputs; the consistent losses compare
    ``a f`` with the labels.
    """
    m = f.shape[1]
    if name == "mse":
        return 0.5 * ((f - y) ** 2).mean(1), (f - y) / m
    if name == "mae":
        return np.abs(f - y).mean(1), np.sign(f - y) / m
    if name == "cross_entropy":
        p = np.clip(f, 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(1), (p - y) / (p * (1 - p))
    if a is None:
        raise ValueError(f"{name} needs an ancestor matrix")
    if name == "mse_con":
        gap = _through(a, f, True) - y
        return 0.5 * (gap**2).mean(1), gap @ a / m / m
    if name == "mse_con_reg":
        gap = _through(a, f - y, False)
        return 0.5 * (gap**2).mean(1), gap @ a / m
    if name == "sd":
        return _distance(f, y, a)
    raise ValueError(f"unknown loss {name}")


LOSSES = ("mse", "mae", "cross_entropy", "mse_con", "mse_con_reg", "sd")
TRAINERS = ("gd", "sgd", "rprop", "rmsprop", "minibatch")


@dataclass(frozen=True)
class Settings:
    """Shape and training of a network; a member trains until any limit is met."""

    hidden: tuple[int, ...] = (10,)
    activation: str = "sigmoid"
    output: str = "sigmoid"
    loss: str = "mse"
    trainer: str = "rprop"
    epochs: int = 60
    rate: float = 0.01
    batch_share: float = 1.0
    validation: float = 0.25
    max_fails: int = 25
    goal: float = 0.0
    min_gradient: float = 1e-7
    min_difference: float = 1e-8
    models: int = 1
    seed: int = 0
    ancestors: Array | None = None
    #: About so many rows for each member, drawn without replacement; 0: all.
    max_rows: int = 0
    #: Learn of a row only the outputs around the lowest of its terms, at least LEAST_TARGETS; needs ``relations``.
    mask: bool = False
    #: (child, parent) indices of outputs.
    relations: tuple[tuple[int, int], ...] = ()


LEAST_TARGETS = 10


def target_mask(y: Array, key: Array, settings: Settings) -> Array:
    """1 for the outputs that a row teaches: its terms without one of its terms below, the children of these, and by chance up to LEAST_TARGETS."""
    m = y.shape[1]
    child = np.zeros((m, m), bool)
    for c, p in settings.relations:
        child[c, p] = True
    below = reachable(child)
    has = y > 1e-6
    # a term of the row that has another one below it is no leaf
    leaf = has & ~(has.astype(float) @ below.astype(float) > 0)
    mask = leaf | (leaf.astype(float) @ child.T.astype(float) > 0)
    h = key.astype(np.int64).view(np.uint64)[:, None] ^ (np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    rank = np.where(mask, 0, 1 + (h ^ (h >> np.uint64(29))) // np.uint64(2)).argsort(1, kind="stable").argsort(1)
    return (mask | (rank < LEAST_TARGETS)).astype(float)


def reachable(child: Array) -> Array:
    """R[i][j]: whether ``i`` lies below ``j``, from ``child[i][j]``."""
    out = child
    while True:
        more = out | (out.astype(np.float32) @ out.astype(np.float32) > 0)
        if (more == out).all():
            return out
        out = more


@dataclass
class Net:
    settings: Settings
    weights: list[tuple[Array, Array]] = field(default_factory=list)
    #: The columns of the labels that this network learns; null: all.
    targets: Array | None = None

    @classmethod
    def start(cls, settings: Settings, n_in: int, n_out: int, seed: int, targets: Array | None = None) -> Net:
        draw = np.random.default_rng(seed)
        sizes = [n_in, *settings.hidden, n_out if targets is None else len(targets)]
        return cls(settings, [(draw.normal(size=(a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)], targets)

    def own(self, y: Array) -> Array:
        return y if self.targets is None else y[:, self.targets]

    def layers(self, x: Array) -> list[Array]:
        out = [x]
        for k, (w, b) in enumerate(self.weights):
            kind = self.settings.output if k == len(self.weights) - 1 else self.settings.activation
            out.append(ACTIVATIONS[kind].f(out[-1] @ w + b))
        return out

    def predict(self, x: Array) -> Array:
        f = self.layers(x)[-1]
        con = self.settings.loss in ("mse_con", "mse_con_reg", "sd")
        return _through(self.settings.ancestors, f, self.settings.loss == "mse_con") if con else f

    def gradient(self, x: Array, y: Array, weight: Array, mask: Array | None = None) -> tuple[Array, float]:
        """Flat gradient and loss, both summed over rows by weight; of outputs that ``mask`` leaves out nothing is learned."""
        layer = self.layers(x)
        value, back = loss(self.settings.loss, layer[-1], self.own(y), self.settings.ancestors)
        back = back * weight[:, None] if mask is None else back * weight[:, None] * mask
        flat: list[Array] = []
        for k in range(len(self.weights) - 1, -1, -1):
            kind = self.settings.output if k == len(self.weights) - 1 else self.settings.activation
            back = back * ACTIVATIONS[kind].slope(layer[k + 1])
            flat = [(layer[k].T @ back).ravel(), back.sum(0), *flat]
            back = back @ self.weights[k][0].T
        return np.concatenate(flat), float((value * weight).sum())

    def flat(self) -> Array:
        return np.concatenate([p.ravel() for w in self.weights for p in w])

    def moved(self, to: Array) -> Net:
        new, at = [], 0
        for w, b in self.weights:
            new.append((to[at : at + w.size].reshape(w.shape), to[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Net(self.settings, new, self.targets)


class Stepper:
    """Turns gradients into steps."""

    def __init__(self, settings: Settings, n: int):
        self.s, self.delta, self.last, self.square = settings, np.full(n, 0.1), np.zeros(n), np.zeros(n)

    def step(self, g: Array) -> Array:
        if self.s.trainer == "rprop":
            sign = g * self.last
            self.delta = np.clip(np.where(sign > 0, self.delta * 1.2, np.where(sign < 0, self.delta * 0.5, self.delta)), 1e-6, 50)
            g = np.where(sign < 0, 0, g)
            self.last = g
            return -np.sign(g) * self.delta
        if self.s.trainer == "rmsprop":
            self.square = 0.9 * self.square + 0.1 * g * g
            return -self.s.rate * g / (np.sqrt(self.square) + 1e-8)
        if self.s.trainer == "sgd":
            return -g
        return -self.s.rate * g


def bag_weights(key: Array, member: int, seed: int) -> Array:
    """How often each row is in a member's bootstrap sample: Poisson counts of mean 1 from hashes."""
    from numpy import uint64

    h = (key.astype(np.int64).view(uint64) ^ uint64((member + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> uint64(31))) * uint64(0x94D049BB133111EB) + uint64(seed)
    u = ((h ^ (h >> uint64(29))) >> uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(12)]), u).astype(float)


def drawn_rows(key: Array, member: int, settings: Settings, total: int) -> Array:
    """Whether each row is among about ``max_rows`` of ``total`` that a member is given."""
    if not settings.max_rows or settings.max_rows >= total:
        return np.ones(len(key), bool)
    h = (key.astype(np.int64).view(np.uint64) + np.uint64((member + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype(float) / (1 << 53) < settings.max_rows / total


def _passed(net: Net, x: Array, y: Array, weight: Array, mask: Array | None = None) -> tuple[Array, float]:
    """Stochastic descent, row after row, through a batch: how far it went back, times the batch's weight, and the loss on the way.

    Summed over all batches and divided by the whole weight this is the mean of
    the batches' ways, so an epoch averages what each batch learned by itself.
    """
    at, value = net, 0.0
    for i in np.flatnonzero(weight > 0):
        g, one = at.gradient(x[i : i + 1], y[i : i + 1], weight[i : i + 1], None if mask is None else mask[i : i + 1])
        at, value = at.moved(at.flat() - net.settings.rate * g), value + one
    return (net.flat() - at.flat()) * weight.sum(), value


def _total(rows: DataFrame, nets: list[Net], active: list[int], epoch: int, total: int) -> dict[int, tuple[Array, float, float, float, float]]:
    """For each active member: gradient, training loss and weight, validation loss and weight."""
    s = nets[0].settings

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, Array] = {}
        for frame in frames:
            if not len(frame):
                continue
            x, y = np.stack(frame["x"]).astype(float), np.stack(frame["y"]).astype(float)
            key = frame["key"].to_numpy()
            check = (key & 0xFFFF) / 65536.0 < s.validation
            drawn = ((key >> 16) + epoch * 40503 & 0xFFFF) / 65536.0 < s.batch_share if s.trainer == "minibatch" else np.ones(len(key), bool)
            for m in active:
                net = nets[m]
                w = bag_weights(key, m, s.seed) if len(nets) > 1 else np.ones(len(key))
                w = w * drawn_rows(key, m, s, total)
                mask = target_mask(net.own(y), key, net.settings) if s.mask else None
                g, train = _passed(net, x, y, w * ~check, mask) if s.trainer == "sgd" else net.gradient(x, y, w * ~check * drawn, mask)
                v = loss(s.loss, net.layers(x)[-1], net.own(y), net.settings.ancestors)[0]
                part = np.concatenate((g, [train, (w * ~check * drawn).sum(), (v * w * check).sum(), (w * check).sum()]))
                sums[m] = sums[m] + part if m in sums else part
        if sums:
            yield pd.DataFrame({"m": list(sums), "s": list(sums.values())})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, Array] = {}
        for frame in frames:
            for m, part in zip(frame["m"], frame["s"], strict=True):
                sums[m] = sums[m] + part if m in sums else np.array(part)
        if sums:
            yield pd.DataFrame({"m": list(sums), "s": list(sums.values())})

    kinds = "m int, s array<double>"
    found = rows.mapInPandas(partial, kinds).repartition(ADDERS, "m").mapInPandas(add, kinds).collect()
    return {r["m"]: (np.array(r["s"][:-4]), *r["s"][-4:]) for r in found}


def train(rows: DataFrame, settings: Settings = Settings(), start: Callable[[int, int], list[Net]] | None = None) -> list[Net]:
    """Train ``settings.models`` networks on ``id, x array<double>, y array<double>``.

    ``start`` makes the networks to begin with from the numbers of inputs and
    outputs; they may have settings and targets of their own.
    """
    keyed = cut(rows.select(F.xxhash64("id", F.lit(settings.seed)).alias("key"), "x", "y"))
    first = keyed.first()
    if first is None:
        return []
    n_in, n_out = len(first["x"]), len(first["y"])
    nets = start(n_in, n_out) if start else [Net.start(settings, n_in, n_out, settings.seed + m) for m in range(settings.models)]
    rows_total = keyed.count() if settings.max_rows else 0
    steppers = [Stepper(settings, len(n.flat())) for n in nets]
    best = [(np.inf, n) for n in nets]
    fails, last, active = [0] * len(nets), [np.inf] * len(nets), list(range(len(nets)))
    for epoch in range(settings.epochs):
        found = _total(keyed, nets, active, epoch, rows_total)
        for m in list(active):
            if m not in found:
                active.remove(m)
                continue
            g, train_loss, n, check_loss, check_n = found[m]
            now = train_loss / max(n, 1e-12)
            seen = check_loss / check_n if check_n else now
            better = seen < best[m][0]
            best[m], fails[m] = ((seen, nets[m]), 0) if better else (best[m], fails[m] + 1)
            g = g / max(n, 1e-12)
            stop = fails[m] > settings.max_fails or now <= settings.goal or np.linalg.norm(g) < settings.min_gradient or abs(last[m] - now) < settings.min_difference
            last[m] = now
            if stop:
                active.remove(m)
            else:
                nets[m] = nets[m].moved(nets[m].flat() + steppers[m].step(g))
        if not active:
            break
    return [n for _, n in best]


def predict(rows: DataFrame, nets: list[Net]) -> DataFrame:
    """``id, f``: the members' mean prediction; null without any member."""
    kind = dict(rows.dtypes)["id"]
    if not nets:
        return rows.select("id", F.lit(None).cast("array<double>").alias("f"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"]).astype(float)
                yield pd.DataFrame({"id": frame["id"], "f": list(np.mean([n.predict(x) for n in nets], 0))})

    return rows.select("id", "x").mapInPandas(run, f"id {kind}, f array<double>")


def predict_out_of_bag(rows: DataFrame, nets: list[Net]) -> DataFrame:
    """``id, f, n``: mean prediction of the members whose bag lacks the row; null if there is none."""
    if not nets:
        return rows.select("id", F.lit(None).cast("array<double>").alias("f"), F.lit(0).cast("long").alias("n"))
    seed, kind = nets[0].settings.seed, dict(rows.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, key = np.stack(frame["x"]).astype(float), frame["key"].to_numpy()
                out = np.stack([bag_weights(key, m, seed) == 0 for m in range(len(nets))])
                f = np.stack([n.predict(x) for n in nets])
                n = out.sum(0)
                mean = (f * out[:, :, None]).sum(0) / np.maximum(n, 1)[:, None]
                yield pd.DataFrame({"id": frame["id"], "f": [v if k else None for v, k in zip(mean, n, strict=True)], "n": n})

    return rows.select("id", "x", F.xxhash64("id", F.lit(seed)).alias("key")).mapInPandas(run, f"id {kind}, f array<double>, n long")


def combine(one: TermEnsemble, two: TermEnsemble) -> TermEnsemble:
    """One ensemble of both, if their terms, relations and scaling are the same; else the first, with a warning."""
    same = one.terms == two.terms and set(one.relations) == set(two.relations) and one.scaler.equal(two.scaler)
    if not same:
        warnings.warn("the ensembles differ in their terms or features: not combined", stacklevel=2)
        return one
    return replace(one, nets=[*one.nets, *two.nets])


def _moments(rows: DataFrame) -> Array:
    """For each target and label 0 or 1 of it: the number of rows, and for each feature the sum and the sum of squares.

    Partitions add up matrices; a few tasks add those of the partitions.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                x, y = np.stack(frame["x"]).astype(float), np.stack(frame["y"]).astype(float) > 0.5
                sides = np.column_stack((~y, y)).astype(float)
                part = sides.T @ np.column_stack((np.ones(len(x)), x, x * x))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, Array] = {}
        for frame in frames:
            for i, row in zip(frame["i"], frame["row"], strict=True):
                sums[i] = sums[i] + row if i in sums else np.array(row)
        if sums:
            yield pd.DataFrame({"i": list(sums), "row": list(sums.values())})

    kinds = "i int, row array<double>"
    found = rows.select("x", "y").mapInPandas(partial, kinds).repartition(ADDERS, "i").mapInPandas(add, kinds).collect()
    return np.array([r["row"] for r in sorted(found, key=lambda r: r["i"])])


def select_features(rows: DataFrame, n_features: int, n_targets: int, level: float = 1e-10, least: int = 5) -> list[int]:
    """Features whose means differ between the labels of some target (Welch's test), at least ``least`` per target.

    The driver gets one row of sums per label of each target.
    """
    if n_features <= least:
        return list(range(n_features))
    sums = _moments(rows).reshape(2, n_targets, 1 + 2 * n_features)
    n, one, two = sums[:, :, :1], sums[:, :, 1 : 1 + n_features], sums[:, :, 1 + n_features :]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = one / n
        spread = np.maximum(two / n - mean * mean, 0) * n / (n - 1)
        # squares that only rounding keeps from being equal
        spread = np.where(spread < 1e-12 * np.maximum(mean * mean, 1e-300), 0.0, spread)
        v = spread / n
        t = (mean[0] - mean[1]) / np.sqrt(v[0] + v[1])
        df = (v[0] + v[1]) ** 2 / (v[0] ** 2 / (n[0] - 1) + v[1] ** 2 / (n[1] - 1))
        exact = (spread[0] == 0) & (spread[1] == 0) & (mean[0] != mean[1])
    chosen: set[int] = set()
    for k in range(n_targets):
        p = [0.0 if exact[k, j] else student_p(t[k, j], df[k, j]) if np.isfinite(t[k, j]) else 2.0 for j in range(n_features)]
        own = sorted((2.0 if v != v else v, j) for j, v in enumerate(p))
        good = [j for v, j in own if v < level]
        chosen |= set(good if len(good) >= least else [j for _, j in own[:least]])
    return sorted(chosen)


@dataclass
class Scaler:
    """Selected features, standardised and turned onto the leading axes."""

    chosen: list[int]
    mean: Array
    sd: Array
    axes: Array

    def __call__(self, x: Array) -> Array:
        return (x[:, self.chosen] - self.mean) / self.sd @ self.axes

    def equal(self, other: Scaler) -> bool:
        return self.chosen == other.chosen and all(a.shape == b.shape and np.allclose(a, b) for a, b in ((self.mean, other.mean), (self.sd, other.sd), (self.axes, other.axes)))


#: Features beyond which principal axes are found from sketches, and columns of the first sketch.
WIDE, SKETCH = 1024, 32


def _summed(rows: DataFrame, part: Callable[[Array], Array]) -> Array:
    """The sum of ``part`` over batches of column ``x``: partitions add up matrices, a few tasks add those of the partitions."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                own = part(np.stack(frame["x"]).astype(float))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, Array] = {}
        for frame in frames:
            for i, row in zip(frame["i"], frame["row"], strict=True):
                sums[i] = sums[i] + row if i in sums else np.array(row)
        if sums:
            yield pd.DataFrame({"i": list(sums), "row": list(sums.values())})

    kinds = "i int, row array<double>"
    found = rows.select("x").mapInPandas(partial, kinds).repartition(ADDERS, "i").mapInPandas(add, kinds).collect()
    return np.array([r["row"] for r in sorted(found, key=lambda r: r["i"])])


def _spread(n: float, mean: Array, square: Array) -> tuple[Array, Array]:
    """Sample deviations, 0 counting as 1, and which features vary."""
    sd = np.sqrt(np.maximum(square - n * mean * mean, 0) / max(n - 1, 1))
    flat = sd < 1e-12
    return np.where(flat, 1.0, sd), ~flat


def _few_axes(rows: DataFrame, chosen: list[int], retain: float, sketch: int = SKETCH, seed: int = 0) -> Scaler:
    """Principal axes of very many features by a randomised range finder.

    The standardised rows times a random matrix of few columns span nearly all
    that the leading axes span, more so after multiplying by the squares once
    more.  Sketches are ``width x columns`` sums; the axes come from the
    small matrix of squares inside their span.  Where that holds too little,
    the sketch gets twice as many columns.
    """
    width = len(chosen)
    one = _summed(rows, lambda x: np.stack((np.full(width, float(len(x))), x[:, chosen].sum(0), (x[:, chosen] ** 2).sum(0))))
    n = one[0, 0]
    mean = one[1] / n
    sd, varies = _spread(n, mean, one[2])
    whole = max(float(varies.sum()) * (n - 1), 1e-300)
    z = lambda x: np.where(varies, (x[:, chosen] - mean) / sd, 0.0)
    draw = np.random.default_rng(seed)
    while True:
        base = draw.normal(size=(width, sketch))
        for _ in range(3):
            span = base
            base = np.linalg.qr(_summed(rows, lambda x, span=span: z(x).T @ (z(x) @ span)))[0]
        small = _summed(rows, lambda x, base=base: (z(x) @ base).T @ (z(x) @ base))
        values, turn = np.linalg.eigh(small)
        values, turn = values[::-1], turn[:, ::-1]
        share = np.cumsum(values) / whole
        if share[-1] >= retain or sketch >= width:
            keep = min(int(np.argmax(share >= retain)) + 1 if share[-1] >= retain else sketch, sketch)
            return Scaler(chosen, mean, sd, (base @ turn)[:, :keep])
        sketch = min(width, 2 * sketch)


def fit_scaler(rows: DataFrame, chosen: list[int], retain: float = 0.99, wide: int = WIDE) -> Scaler:
    """Means, sample deviations (0 counts as 1) and the axes that hold ``retain`` of the squares.

    Partitions sum their outer products; the driver gets one matrix, of as many
    rows and columns as features, and for more than ``wide`` of these one of few columns.
    """
    width = len(chosen)
    if width > wide:
        return _few_axes(rows, chosen, retain)

    def products(x: Array) -> Array:
        x = np.column_stack((x[:, chosen], np.ones(len(x))))
        return x.T @ x

    m = _summed(rows, products)
    n = m[-1, -1]
    mean = m[-1, :-1] / n
    cov = m[:-1, :-1] - n * np.outer(mean, mean)
    sd, _ = _spread(n, mean, np.diag(m)[:-1])
    values, axes = np.linalg.eigh(cov / np.outer(sd, sd))
    values, axes = values[::-1], axes[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    keep = int(np.argmax(share >= retain)) + 1
    return Scaler(chosen, mean, sd, axes[:, :keep])


def scaled(rows: DataFrame, scaler: Scaler) -> DataFrame:
    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                frame["x"] = list(scaler(np.stack(frame["x"]).astype(float)))
                yield frame

    return rows.mapInPandas(run, kinds)


@dataclass
class TermEnsemble:
    """Networks over the terms of an ontology: what they were scaled by, the terms in order, and (child, parent) indices, lowest first."""

    scaler: Scaler
    nets: list[Net]
    terms: list[str]
    relations: list[tuple[int, int]] = field(default_factory=list)


def ancestor_matrix(terms: list[str], closure: list[tuple[str, str]]) -> Array:
    """A[i][j] = 1 where term i is term j or one of its ancestors."""
    at = {t: i for i, t in enumerate(terms)}
    out = np.eye(len(terms))
    for t, a in closure:
        if t in at and a in at:
            out[at[a], at[t]] = 1
    return out


def train_terms(rows: DataFrame, terms: list[str], closure: list[tuple[str, str]], settings: Settings = Settings(models=5)) -> TermEnsemble:
    """Select features, scale them, and train an ensemble whose outputs are ``terms``."""
    first = rows.first()
    if first is None:
        return TermEnsemble(Scaler([], np.zeros(0), np.ones(0), np.zeros((0, 0))), [], terms)
    chosen = select_features(rows, len(first["x"]), len(terms))
    scaler = fit_scaler(rows, chosen)
    a = ancestor_matrix(terms, closure)
    return TermEnsemble(scaler, train(scaled(rows, scaler), replace(settings, ancestors=a)), terms)


def predict_terms(rows: DataFrame, model: TermEnsemble) -> DataFrame:
    """``id, f``: predictions where no term scores less than one of its descendants."""
    if not model.nets:
        return predict(rows, [])
    a = model.nets[0].settings.ancestors
    raw = predict(scaled(rows.select("id", "x"), model.scaler), model.nets)
    best = F.array(*[F.greatest(*([F.col("f")[j] for j in np.flatnonzero(a[i])] if a[i].sum() > 1 else [F.col("f")[i], F.col("f")[i]])) for i in range(len(model.terms))])
    return raw.select("id", best.alias("f"))


def drawn_terms(terms: list[str], models: int, k: int, seed: int = 0) -> list[list[int]]:
    """For each member ``k`` different indices of ``terms``, ascending; all of them where ``k`` is 0 or too many."""
    if not 0 < k < len(terms):
        return [list(range(len(terms))) for _ in range(models)]
    return [sorted(np.random.default_rng((seed, m)).choice(len(terms), k, replace=False).tolist()) for m in range(models)]


def train_members(rows: DataFrame, terms: list[str], rel: DataFrame, settings: Settings = Settings(models=5), per_member: int = 0) -> TermEnsemble:
    """An ensemble whose members each learn ``per_member`` of the ``terms``, drawn without replacement, on an ontology of just these.

    ``rel`` (``child, parent``) may name further terms.  The members'
    ontologies are contracted in one job; their ancestor matrices serve the
    consistent losses, and the relations the masks.  Features are selected and
    scaled once for all members.
    """
    spark = rows.sparkSession
    at = {t: i for i, t in enumerate(terms)}
    drawn = drawn_terms(terms, settings.models, per_member, settings.seed)
    chosen = spark.createDataFrame([(m, terms[i]) for m, own in enumerate(drawn) for i in own], "member int, id string")
    told = ontology.subontologies(rel, chosen, settings.models).collect()
    level = {r["id"]: r["level"] for r in ontology.levels(rel).collect()}
    listed = spark.createDataFrame([(t,) for t in terms], "id string")
    whole = [(r["child"], r["parent"]) for r in ontology.subontology(rel, listed).collect()]
    relations = [(at[c], at[p]) for c, p in sorted(whole, key=lambda r: (-level[r[0]], r))]
    first = rows.first()
    if first is None:
        return TermEnsemble(Scaler([], np.zeros(0), np.ones(0), np.zeros((0, 0))), [], terms, relations)
    scaler = fit_scaler(rows, select_features(rows, len(first["x"]), len(terms)))

    def start(n_in: int, n_out: int) -> list[Net]:
        nets = []
        for m, own in enumerate(drawn):
            place = {terms[i]: k for k, i in enumerate(own)}
            links = tuple(sorted((place[r["child"]], place[r["parent"]]) for r in told if r["member"] == m))
            child = np.zeros((len(own), len(own)), bool)
            for c, p in links:
                child[c, p] = True
            above = np.eye(len(own)) + reachable(child).T
            nets.append(Net.start(replace(settings, ancestors=above, relations=links), n_in, n_out, settings.seed + m, np.array(own)))
        return nets

    return TermEnsemble(scaler, train(scaled(rows, scaler), settings, start), terms, relations)


def predict_members(rows: DataFrame, model: TermEnsemble) -> DataFrame:
    """``id, f``: the mean of the members' predictions for all terms; null without any member.

    A member's predictions of its own terms, 0 for all others, are carried up
    the whole ontology by the maximum and divided by the largest row sum of its
    ancestor matrix, the most that a term of it can add up.
    """
    kind = dict(rows.dtypes)["id"]
    if not model.nets:
        return predict(rows, [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = model.scaler(np.stack(frame["x"]).astype(float))
                mean = np.zeros((len(x), len(model.terms)))
                for net in model.nets:
                    f = np.zeros_like(mean)
                    f[:, slice(None) if net.targets is None else net.targets] = net.predict(x)
                    for c, p in model.relations:
                        np.maximum(f[:, p], f[:, c], out=f[:, p])
                    mean += f / (1.0 if net.settings.ancestors is None else net.settings.ancestors.sum(1).max())
                yield pd.DataFrame({"id": frame["id"], "f": list(mean / len(model.nets))})

    return rows.select("id", "x").mapInPandas(run, f"id {kind}, f array<double>")


def is_consistent(predictions: DataFrame, ancestors: Array, slack: float = 1e-9) -> DataFrame:
    """``id, consistent``: whether no term of ``f`` scores less than one of its descendants."""
    below = [(i, int(j)) for i in range(len(ancestors)) for j in np.flatnonzero(ancestors[i]) if i != j]
    pairs = F.array(*[F.struct(F.lit(i).alias("up"), F.lit(j).alias("down")) for i, j in below]) if below else F.array().cast("array<struct<up:int,down:int>>")
    holds = F.forall(pairs, lambda p: F.get("f", p["up"]) >= F.get("f", p["down"]) - F.lit(slack))
    return predictions.select("id", holds.alias("consistent"))


def save_nets(spark: SparkSession, nets: list[Net], path: str) -> None:
    """An ensemble as Parquet: a row per member with its settings, the sizes of its layers and its weights."""
    rows = []
    for m, net in enumerate(nets):
        told = asdict(replace(net.settings, ancestors=None)) | {"targets": None if net.targets is None else [int(t) for t in net.targets]}
        a = net.settings.ancestors
        rows.append((m, json.dumps(told), [w.shape[0] for w, _ in net.weights] + [net.weights[-1][0].shape[1]], net.flat().tolist(), None if a is None else a.astype(float).ravel().tolist()))
    kinds = "member int, settings string, sizes array<int>, weights array<double>, ancestors array<double>"
    spark.createDataFrame(rows, kinds).write.mode("overwrite").parquet(path)


def load_nets(spark: SparkSession, path: str) -> list[Net]:
    out = []
    for r in sorted(spark.read.parquet(path).collect(), key=lambda r: r["member"]):
        told = json.loads(r["settings"])
        a = r["ancestors"]
        square = None if a is None else np.array(a).reshape(r["sizes"][-1], -1)
        targets = told.pop("targets", None)
        settings = Settings(**{**told, "hidden": tuple(told["hidden"]), "ancestors": square, "relations": tuple(map(tuple, told.get("relations", ())))})
        net = Net(settings, [(np.zeros((i, o)), np.zeros(o)) for i, o in zip(r["sizes"], r["sizes"][1:], strict=False)], None if targets is None else np.array(targets))
        out.append(net.moved(np.array(r["weights"])))
    return out


def save_terms(spark: SparkSession, model: TermEnsemble, path: str) -> None:
    """A term ensemble: its networks, and one row of what they were scaled by and their terms."""
    s = model.scaler
    row = (list(map(int, s.chosen)), s.mean.tolist(), s.sd.tolist(), s.axes.ravel().tolist(), model.terms, [list(map(int, r)) for r in model.relations])
    kinds = "chosen array<int>, mean array<double>, sd array<double>, axes array<double>, terms array<string>, relations array<array<int>>"
    spark.createDataFrame([row], kinds).write.mode("overwrite").parquet(f"{path}/scaler")
    save_nets(spark, model.nets, f"{path}/nets")


def load_terms(spark: SparkSession, path: str) -> TermEnsemble:
    r = spark.read.parquet(f"{path}/scaler").first()
    axes = np.array(r["axes"], float).reshape(len(r["chosen"]), -1) if r["axes"] else np.zeros((len(r["chosen"]), 0))
    return TermEnsemble(Scaler(list(r["chosen"]), np.array(r["mean"]), np.array(r["sd"]), axes), load_nets(spark, f"{path}/nets"), list(r["terms"]), [tuple(p) for p in r["relations"]])


def save_codebook(spark: SparkSession, centroids: Array, path: str) -> None:
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "code int, x array<double>").write.mode("overwrite").parquet(path)


def load_codebook(spark: SparkSession, path: str) -> Array:
    return np.array([r["x"] for r in sorted(spark.read.parquet(path).collect(), key=lambda r: r["code"])])


# --- vector quantisation ----------------------------------------------------------------------

#: Points of a series that lie together.
RANGE = 4096


def points(rows: DataFrame, id: str, order: list[str], value: str) -> DataFrame:
    """``id, at, x, total``: the values of each series numbered from 0 in the order given, and how many it has; written down.

    Rows without an id or a value are no points.  A series may hold any share of the rows.
    """
    named = rows.where(F.col(id).isNotNull() & F.col(value).isNotNull()).select(F.col(id).alias("id"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(value).cast("double").alias("x"))
    return ordered_rank(named, "id", [f"_o{k}" for k in range(len(order))]).select("id", "at", "x", "total")


def windows(series: DataFrame, length: int = 16, step: int = 1, size: int = RANGE) -> DataFrame:
    """``id, at, x``: windows of ``length`` values of ``series`` (``points``), each ``step``-th; as ever, the last possible one is left out.

    A series lies in ranges of ``size`` points.  Each range also gets the first
    ``length - 1`` points of the next one, so that it has all of its windows
    and no array is longer than a window.
    """
    size = max(size, length)
    own = F.floor(F.col("at") / size)
    halo = (F.col("at") % size < length - 1) & (own > 0)
    dealt = series.where(F.col("total") > length).withColumn("range", F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))))
    over = Window.partitionBy("id", "range").orderBy("at").rowsBetween(0, length - 1)
    seen = dealt.withColumn("w", F.collect_list("x").over(over))
    return seen.where((own == F.col("range")) & (F.col("at") + length < F.col("total")) & (F.col("at") % step == 0)).select("id", "at", F.col("w").alias("x"))


def quotas(series: DataFrame, most: int, short: bool = False) -> DataFrame:
    """``id, quota``: how many of at most ``most`` samples each series gets: one, and of what is left a part by its length.

    More series than samples are an error, unless ``short``: what is missing is then taken off by length too, which makes quotas of 0 and less.
    """
    length = series.groupBy("id").agg(F.max("total").alias("n"))
    told = length.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if told["k"] > most and not short:
        raise ValueError(f"{told['k']} series are more than {most} samples")
    rest = max(1, (told["n"] or 0) - told["k"])
    return length.select("id", (F.floor((F.col("n") - 1).cast("double") / rest * (most - told["k"])) + 1).cast("long").alias("quota"))


def sampled_windows(series: DataFrame, length: int = 16, most: int = 20_000, step: int = 1, seed: int = 1) -> DataFrame:
    """``id, at, x``: as many windows of each series as its quota, or all it has: those with the least hashes.

    No series goes without: where there are more than ``most``, each gives one window.  Windows are counted by the leading zeros of their hashes; the counts tell
    how many zeros leave enough, about twice the quota, and only these are ranked.
    """
    every = windows(series, length, step)
    drawn = every.withColumn("h", F.shiftrightunsigned(F.xxhash64("id", "at", F.lit(seed)), 1)).withColumn("zeros", (63 - F.floor(F.log2(F.greatest("h", F.lit(1))))).cast("int"))
    quota = quotas(series, most, short=True).withColumn("quota", F.greatest("quota", F.lit(1)))
    counted = drawn.groupBy("id", "zeros").agg(F.count("*").alias("n")).join(quota, "id")
    upto = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("zeros")))
    least = counted.withColumn("upto", upto).groupBy("id").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("quota"), F.col("zeros"))), F.lit(0)).alias("least"), F.max("quota").alias("quota"))
    few = drawn.join(least, "id").where(F.col("zeros") >= F.col("least"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("h", "at"))
    return few.withColumn("rank", rank).where(F.col("rank") <= F.col("quota")).select("id", "at", "x")


def codebook(series: DataFrame, clusters: int = 16, length: int = 16, most: int = 20_000, seed: int = 1) -> Array:
    """Centroids of windows by k-means, on ``most`` windows at most, dealt to the series by their lengths, or on one of each series if these are more."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = cut(sampled_windows(series, length, most, seed=seed).select(array_to_vector("x").alias("features")))
    return np.array(KMeans(k=clusters, maxIter=100, seed=seed).fit(some).clusterCenters())


def quantised(series: DataFrame, centroids: Array, normalize: bool = True) -> DataFrame:
    """``id, code, n, share``: how many windows of a series are nearest to each centroid."""

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        v = np.stack(x).astype(float)
        return pd.Series(((v**2).sum(1)[:, None] - 2 * v @ centroids.T + (centroids**2).sum(1)).argmin(1))

    n = windows(series, centroids.shape[1]).select("id", nearest("x").alias("code")).groupBy("id", "code").agg(F.count("*").alias("n"))
    total = n.groupBy("id").agg(F.sum("n").alias("_t"))
    return n.join(total, "id").select("id", "code", "n", (F.col("n") / F.col("_t") if normalize else F.col("n").cast("double")).alias("share"))
