"""Personal data: exact base patterns, and a semi-Markov conditional random field beside them.

The field reads stretches of text that hold a digit, an ``@`` or one spelled
out, cut into atoms (runs of digits, runs of letters, single other characters).
A candidate segment is a run of at most ``LONGEST`` atoms whose whole span has
the general shape of some kind, which is wider than its base pattern; its score
is a weighted sum of features of the whole span.  Dynamic programming over the
segments chooses boundaries and kinds jointly.

It is fitted on stretches of the corpus in which base matches are the truth and
most of them are rewritten as people write such data where the patterns do not
reach: other separators, no plus sign, signs spelled out.  So it learns from
shape, checks and context what the patterns cannot find.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Most atoms in a segment; stretches that the weights are fitted on, and their longest; passes, step and penalty of the fit.
LONGEST, FITTED_ON, LONG_STRETCH, PASSES, RATE, PENALTY = 28, 1200, 400, 6, 0.5, 1e-3
#: Rewritten copies of each stretch that holds base spans, beside itself.
COPIES = 6
FEATURES = (
    "bias", "base match", "checks hold", "letter before", "digit before", "letter after", "digit after", "joiner before", "joiner after", "one separator", "even groups",
    "groups", "digits", "plus or zeros first", "bracket", "longer exists", "shorter exists", "spelled out", "starts stretch", "ends stretch",
)
_AT, _DOT = r"(?:@|\x20@\x20|\x20?[(\[](?:at|AT)[)\]]\x20?)", r"(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)"
#: General shapes of candidate spans, without the base patterns' checks.
SHAPES = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\.|,|\[\.\]|\(\.\))[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]+(?:(?:[\x20._/-]|\x20-\x20)[0-9]+)*"),
    "phone": re.compile(r"\+?\(?[0-9]+(?:[\x20()./-]{1,2}[0-9]+)*"),
}
DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (9, 15)}

_SPELLED = r"[(\[](?:at|AT|dot|DOT)[)\]]"
#: Whether the field has anything to read.
_READS = re.compile(r"[0-9@]|[(\[](?:at|AT)[)\]]")
_WORD = r"[A-Za-z0-9._%+@()\[\],/\-]"
_STRETCH = re.compile(rf"{_WORD}+(?:\x20(?:@\x20{_WORD}+|{_SPELLED}\x20{_WORD}+|[0-9()+.\-]{_WORD}*))*")
# the same matches in linear time: no second look at a run of digits, and e-mail addresses by their @
_IP = re.compile(r"(?<![0-9])" + PATTERNS["ip"].pattern)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The checks on a span that has the shape of its kind."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))
    digits = re.sub(r"[^0-9]", "", text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[Span]:
    """What the e-mail pattern finds, without trying every start of a long word."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end(), "email"
            free = m.end()


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    found = list(_emails(text))
    for kind, pattern in (("ip", _IP), ("card", PATTERNS["card"]), ("phone", PATTERNS["phone"])):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Lattice:
    """Atom boundaries of a stretch and its candidate segments: (first atom, end atom, kind, features)."""

    edges: list[int]
    segments: list[tuple[int, int, str, np.ndarray]]


def _side(c: str) -> tuple[float, float, float]:
    return float(c.isalpha()), float(c.isdigit()), float(c in ".-_@+" and c != "")


def checked(kind: str, text: str) -> bool:
    """The checks of the kind on a span of general shape, its separators aside."""
    if kind == "email":
        return bool(re.search(r"[^A-Za-z][A-Za-z]{2,4}$", text))
    groups = re.findall(r"[0-9]+", text)
    if kind == "ip":
        return all(int(g) <= 255 for g in groups)
    digits = "".join(groups)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _features(kind: str, span: str, before: str, after: str, longer: bool, shorter: bool, first: bool, last: bool) -> np.ndarray:
    a, b = _side(before), _side(after)
    groups = re.findall(r"[0-9]+", span)
    between = {x for x in re.split(r"[0-9]+", span.strip("+()")) if x}
    base = bool(PATTERNS[kind].fullmatch(span)) and valid(kind, span)
    even = len(groups) > 1 and len({len(g) for g in groups[:-1]}) == 1 and len(groups[-1]) <= len(groups[0])
    spelled = bool(re.search(r"(?:\b(?:at|AT|dot|DOT)\b)|\[\.\]|\(\.\)|\x20@\x20", span))
    return np.array((
        1.0, base, checked(kind, span), a[0], a[1], b[0], b[1], a[2], b[2], len(between) == 1, even,
        min(len(groups), 6) / 6, min(sum(map(len, groups)), 20) / 20, span.startswith(("+", "00")), "(" in span, longer, shorter, spelled, first, last,
    ), float)


def lattice(stretch: str, before: str = "", after: str = "") -> Lattice:
    atoms = list(_ATOM.finditer(stretch))
    edges = [0, *(m.end() for m in atoms)]
    digits = [0]
    letters = [0]
    for m in atoms:
        digits.append(digits[-1] + (len(m[0]) if m[0][0].isdigit() else 0))
        letters.append(letters[-1] + m[0][0].isalpha())
    out = []
    signs = "@" in stretch or bool(re.search(r"\b(?:at|AT)\b", stretch))
    for i, start in enumerate(edges[:-1]):
        c = stretch[start]
        reach = range(i + 1, min(len(edges), i + LONGEST + 1))
        for kind in KINDS:
            if kind == "email":
                # an address is never entered in the middle of its first part
                if not signs or c not in _LOCAL or start and stretch[start - 1] in _LOCAL:
                    continue
                ends = [j for j in reach if stretch[edges[j] - 1].isalnum() and SHAPES[kind].fullmatch(stretch, start, edges[j])]
            else:
                if not (c.isdigit() or kind == "phone" and c in "+("):
                    continue
                low, high = DIGITS[kind]
                ends = [j for j in reach if low <= digits[j] - digits[i] <= high and letters[j] == letters[i] and stretch[edges[j] - 1].isdigit() and SHAPES[kind].fullmatch(stretch, start, edges[j])]
            for j in ends:
                left = stretch[start - 1] if start else before
                right = stretch[edges[j]] if edges[j] < len(stretch) else after
                x = _features(kind, stretch[start : edges[j]], left, right, j != ends[-1], j != ends[0], start == 0, edges[j] == len(stretch))
                out.append((i, j, kind, x))
    return Lattice(edges, out)


def _forward(size: int, scored: list[tuple[int, int, float]]) -> np.ndarray:
    """Log-sums over all ways to cut the first j atoms into segments and single outside atoms."""
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, j, s in scored:
        by_end.setdefault(j, []).append((i, s))
    a = np.zeros(size)
    for j in range(1, size):
        a[j] = np.logaddexp.reduce([a[j - 1], *(a[i] + s for i, s in by_end.get(j, ()))])
    return a


def fit(stretches: list[tuple[str, str, str, list[Span]]]) -> dict[str, np.ndarray]:
    """Weights by kind that raise the likelihood of the given segmentations (text, before, after, spans).

    Gradients are observed minus expected features; expectations come from the
    forward and backward sums over the lattice.
    """
    weights = {k: np.concatenate(([-4.0, 2.0], np.zeros(len(FEATURES) - 2))) for k in KINDS}
    squares = {k: np.full(len(FEATURES), 1e-2) for k in KINDS}
    lattices = [(lattice(t, b, a), {(s, e, k) for s, e, k in spans}) for t, b, a, spans in stretches]
    for _ in range(PASSES):
        for grid, truth in lattices:
            if not grid.segments:
                continue
            n = len(grid.edges)
            scored = [(i, j, float(weights[k] @ x)) for i, j, k, x in grid.segments]
            a = _forward(n, scored)
            b = _forward(n, [(n - 1 - j, n - 1 - i, s) for i, j, s in scored])[::-1]
            gradient = {k: -PENALTY * w for k, w in weights.items()}
            for (i, j, k, x), (_, _, s) in zip(grid.segments, scored, strict=True):
                seen = float((grid.edges[i], grid.edges[j], k) in truth)
                gradient[k] = gradient[k] + (seen - math.exp(min(0.0, a[i] + s + b[j] - a[-1]))) * x
            for k in KINDS:
                squares[k] += gradient[k] ** 2
                weights[k] = weights[k] + RATE * gradient[k] / np.sqrt(squares[k])
    return weights


def decode(grid: Lattice, weights: dict[str, np.ndarray]) -> list[Span]:
    """The best segmentation: (start, end, kind) inside the stretch."""
    best: list[tuple[float, tuple | None]] = [(0.0, None)]
    by_end: dict[int, list] = {}
    for segment in grid.segments:
        by_end.setdefault(segment[1], []).append(segment)
    for j in range(1, len(grid.edges)):
        top = (best[j - 1][0], None)
        for i, _, k, x in by_end.get(j, ()):
            s = best[i][0] + float(weights[k] @ x)
            if s > top[0]:
                top = (s, (i, k))
        best.append(top)
    out, j = [], len(grid.edges) - 1
    while j > 0:
        step = best[j][1]
        if step:
            out.append((grid.edges[step[0]], grid.edges[j], step[1]))
        j = step[0] if step else j - 1
    return out[::-1]


def stretches(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, stretch, character before, character after) of what the field reads."""
    for m in _STRETCH.finditer(text):
        if _READS.search(m[0]):
            yield m.start(), m[0], text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]


def spans_of(text: str, weights: dict[str, np.ndarray]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the field adds segments that overlap no base span."""
    if not _READS.search(text):
        return [], []
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    furthest = list(accumulate((e for _, e, _ in base), max))
    added = []
    for start, stretch, before, after in stretches(text):
        for s, e, k in decode(lattice(stretch, before, after), weights):
            s, e = s + start, e + start
            n = bisect_left(starts, e)
            if not n or furthest[n - 1] <= s:
                added.append((s, e, k))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def rewritten(span: str, kind: str, draw: np.random.Generator) -> str:
    """The same data as its base pattern does not have it."""
    pick = lambda *of: of[int(draw.integers(len(of)))]
    if kind == "email":
        at, dot = pick(("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), ("(at)", "(dot)"))
        name, host = span.split("@", 1)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return span.replace(".", pick("[.]", "(.)", ","))
    if kind == "card":
        digits, sep = re.sub("[^0-9]", "", span), pick(".", "_", "/", " - ")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups, sep = re.findall("[0-9]+", span), pick(" ", "-", ".", "/")
    if len(groups) == 1:
        groups = [groups[0][:3], groups[0][3:6], groups[0][6:]]
    out = sep.join(g for g in groups if g)
    return pick("00" + out, out, f"({groups[0]}) " + sep.join(groups[1:]))


def spoiled(stretch: str, spans: list[Span], draw: np.random.Generator) -> tuple[str, list[Span]]:
    """A stretch with most of its spans rewritten, and where they are then; spans that overlap an earlier one stay out."""
    parts, kept, at, size = [], [], 0, 0
    for s, e, k in spans:
        if s < at:
            continue
        new = rewritten(stretch[s:e], k, draw) if draw.random() < 0.8 else stretch[s:e]
        parts += [stretch[at:s], new]
        size += s - at
        kept.append((size, size + len(new), k))
        size += len(new)
        at = e
    return "".join(parts) + stretch[at:], kept


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def train(docs: DataFrame, fitted_on: int = FITTED_ON) -> dict[str, np.ndarray]:
    """Fit on ``fitted_on`` of all stretches at most, chosen by a hash of document and place, and the base spans inside them.

    A first pass counts the stretches, so that about as many are drawn; of
    these the driver gets the first by their draw, and none longer than
    ``LONG_STRETCH``.
    """
    seeded = docs.select("doc_id", "text").where(F.col("text").rlike(_READS.pattern))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [sum(1 for frame in frames for text in frame["text"] for _ in stretches(text))]})

    total = seeded.mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0
    share = 1.2 * fitted_on / max(total, 1)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                base = None
                for start, stretch, before, after in stretches(text):
                    turn = int(hashlib.sha256(f"{doc} {start} {stretch}".encode()).hexdigest()[:12], 16)
                    if turn < share * (1 << 48) and len(stretch) <= LONG_STRETCH:
                        base = base_spans(text) if base is None else base
                        own = [f"{s - start}:{e - start}:{k}" for s, e, k in base if start <= s and e <= start + len(stretch)]
                        rows.append((turn, stretch, before, after, own))
            if rows:
                yield pd.DataFrame(rows, columns=["turn", "stretch", "before", "after", "own"])

    drawn = seeded.mapInPandas(draw, "turn long, stretch string, before string, after string, own array<string>")
    rows = drawn.orderBy("turn", "stretch", "before", "after").limit(fitted_on).collect()
    turn, told = np.random.default_rng(5), []
    for r in rows:
        own = [(int(s), int(e), k) for s, e, k in (x.split(":") for x in r["own"])]
        told.append((r["stretch"], r["before"], r["after"], own))
        for _ in range(COPIES if own else 0):
            text, spans = spoiled(r["stretch"], own, turn)
            told.append((text, r["before"], r["after"], spans))
    return fit(told)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Personal data of every row of ``docs`` (``doc_id``, ``text``).

    ``n_*`` count base spans; ``base_sha256`` is the digest of their list;
    ``spans`` lists base and added spans as ``kind:start:end``, in code points;
    ``n_added`` counts the latter.  A null or empty text has no spans; repeated
    rows get equal results; an empty table gives an empty result; other columns
    are ignored.  Finding is one narrow pass; fitting reads a bounded number of
    stretches, the smallest by a hash.
    """
    weights = train(docs) if weights is None else weights

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                base, every = spans_of(text or "", weights)
                kinds = [k for _, _, k in base]
                rows.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def redact(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    weights = train(docs) if weights is None else weights

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for text in frame["text"]:
                at, parts = 0, []
                for s, e, k in spans_of(text or "", weights)[1]:
                    if s >= at:
                        parts += [text[at:s], f"<{k}>"]
                        at = e
                texts.append(None if text is None else "".join(parts) + text[at:])
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text": texts})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string")
