"""Language identification in two levels.

A one-versus-rest linear SVM tells the language family; inside the family
one-versus-one linear SVMs tell the closely related languages apart.  The
features are hashed letter trigrams of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.textops import blocks, memory_of, sliced
from netloom.plans.session import small_batches

#: Family of a language code.  A code that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}
UNKNOWN = "und"
#: Hash buckets of trigrams (a power of two), and labelled texts of each language that the model is fitted on, about.
BUCKETS, PER_LANGUAGE = 4096, 400
#: Texts whose features are worked out at once; each takes BUCKETS numbers a few times over.
AT_ONCE = 64
#: Weight of errors against the margin, passes of the solver, slope from margins to probabilities.
COST, PASSES, SLOPE = 4.0, 30, 4.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors of the square roots of hashed trigram counts."""
    raw = [t.lower().encode() for t in texts]
    data = _FOLD[np.frombuffer(b" ".join(raw) + b"   ", np.uint8)].astype(np.uint32)
    code = data[:-2] << np.uint32(16)
    code |= data[1:-1] << np.uint32(8)
    code |= data[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - BUCKETS.bit_length() + 1)
    out, at = np.zeros((len(raw), BUCKETS)), 0
    for i, r in enumerate(raw):
        if len(r) > 1:
            out[i] = np.bincount(code[at : at + len(r) - 1].astype(np.intp), minlength=BUCKETS)
        at += len(r) + 1
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fit_svm(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent."""
    x = np.column_stack((x, np.ones(len(x))))
    y = np.where(positive, 1.0, -1.0)
    gram, ridge = x @ x.T, 0.5 / COST
    alpha, reach = np.zeros(len(x)), np.zeros(len(x))
    turn = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in turn.permutation(len(x)):
            old = alpha[i]
            alpha[i] = max(0.0, old - (y[i] * reach[i] - 1 + ridge * old) / (gram[i, i] + ridge))
            if alpha[i] != old:
                reach += (alpha[i] - old) * y[i] * gram[i]
    return x.T @ (alpha * y)


@dataclass
class Model:
    """``family[f]``: weights of a family; ``pair[(a, b)]``: weights that are positive for ``a``."""

    members: dict[str, list[str]]
    family: dict[str, np.ndarray]
    pair: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, list[str]]:
        """(language, probability, family) of each row of features."""
        n, names = len(x), sorted(self.members)
        if not names:
            return [UNKNOWN] * n, np.zeros(n), [UNKNOWN] * n
        x = np.column_stack((x, np.ones(n)))
        margins = np.column_stack([x @ self.family[f] for f in names]) if len(names) > 1 else np.zeros((n, 1))
        odds = np.exp(SLOPE * (margins - margins.max(1, keepdims=True)))
        odds /= odds.sum(1, keepdims=True)
        best = margins.argmax(1)
        lang, score = np.empty(n, object), odds[np.arange(n), best]
        for k, f in enumerate(names):
            own, langs = np.flatnonzero(best == k), self.members[f]
            wins = np.zeros((len(own), len(langs)))
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                p = 1 / (1 + np.exp(-SLOPE * (x[own] @ self.pair[a, b])))
                wins[:, i] += p
                wins[:, j] += 1 - p
            pick = wins.argmax(1)
            lang[own] = np.array(langs, object)[pick]
            if len(langs) > 1:
                score[own] *= wins[np.arange(len(own)), pick] / (len(langs) - 1)
        return list(lang), np.clip(score, 0, 1), [names[k] for k in best]


def fit(x: np.ndarray, lang: list[str], families: dict[str, str] = FAMILIES) -> Model:
    members: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        members.setdefault(families.get(code, code), []).append(code)
    code = np.array(lang, object)
    of = np.array([families.get(c, c) for c in lang], object)
    family = {f: fit_svm(x, of == f) for f in members} if len(members) > 1 else {}
    pair = {}
    for langs in members.values():
        for a, b in combinations(langs, 2):
            two = (code == a) | (code == b)
            pair[a, b] = fit_svm(x[two], code[two] == a)
    return Model(members, family, pair)


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` texts of each language, chosen by a hash; held-out rows are never read.

    The driver gets ``BUCKETS`` numbers for each chosen text and no text.
    """
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(remainder(4) != 2)
    share = {r["lang"]: per_language / r["count"] for r in usable.groupBy("lang").count().collect()}
    if not share:
        return Model({}, {}, {})
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.where(draw < F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang"))).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("langid")
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                x = features(some.column(1).to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = chosen.mapInArrow(vectors, "lang string, x binary").limit(2 * per_language * len(share)).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not rows:
        return Model({}, {}, {})
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(float), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score, family`` for every row, from its text alone, and the columns ``keep``."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "lang_pred", "score", "family", *keep]
    # a text goes to the worker once
    sent = ["doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("langid")
        for batch in sliced(batches, AT_ONCE):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, raw in blocks([t.encode() for t in texts]):
                some = texts[first : first + len(raw)]
                lang, score, family = model.predict(features(some))
                letters = [any(map(str.isalpha, t)) for t in some]
                lang = [x if ok else UNKNOWN for x, ok in zip(lang, letters, strict=True)]
                family = [x if ok else UNKNOWN for x, ok in zip(family, letters, strict=True)]
                own = [batch.column(sent.index(c)).slice(first, len(some)) for c in keep]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(family, pa.string()), *own], names)

    kinds = dict(docs.dtypes)
    schema = "doc_id long, lang_pred string, score double, family string" + "".join(f", {c} {kinds[c]}" for c in keep)
    return docs.select(*sent).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` (``doc_id``, ``text``, ``lang``) and predict every row of it.

    Returns ``doc_id, held_out, lang_pred, score, family``.  Texts that are null
    or have no letter are ``und`` with score 0, as is every text when there is
    nothing to learn from; a single known language is predicted for all
    others.  ``held_out``: crc32 of the id mod 4 is 2; false for a null id,
    which is not learned from either.  Rows are predicted one by one, so
    repeated rows get equal results; an empty table gives an empty result.
    """
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "family")
