"""Benchmark decontamination: item-sized windows of documents against benchmark items.

Items go out to the tasks in blocks of a fixed size; a document's windows are
compared where it lies, so no text is shuffled.  For a window of as many words
as an item to reach the similarity, nearly all of its shingles must be shingles
of items, which running sums tell for every window at once.  Windows that pass
get a SimHash; multi-index tables of the items' SimHashes find every item
within the radius; and the exact similarity of the weighted shingles decides.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.textops import Block, blocks, sliced
from netloom.operators.hubs import needed
from netloom.plans.session import cut

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints at a similarity of 0.8 are 9.7 bits apart on average, with a deviation of 2.9: RADIUS is five of
#: these above.  With fewer than FEW shingles on one side the law is coarser, and every item of the length is compared.
RADIUS, FEW = 24, 16
#: Blocks of a fingerprint; some block of two within RADIUS differs in at most RADIUS // TABLES bits.
TABLES = 8
#: Items, and bytes of them, that go out at once; more are more passes over the documents.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 1 << 26

_SIZE = 64 // TABLES
_BLOCK = np.arange(1 << _SIZE, dtype=np.uint64)
#: For each value of a block, the values at most RADIUS // TABLES bits away.
_NEAR = [np.flatnonzero(np.bitwise_count(_BLOCK ^ v) <= RADIUS // TABLES) for v in _BLOCK]

#: Bytes that separate words: all of ASCII but letters and digits.
_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[97:123] = False
_GAPS[128:] = False


def normalised(text: str | None) -> bytes:
    return (text or "").lower().encode()


def _bits(h: np.ndarray) -> np.ndarray:
    """The 64 bits of each value as +1 and -1."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two shingle multisets; a shingle weighs as often as it occurs."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 0.0


@dataclass
class Items:
    """Benchmark items, by their number of words."""

    ids: list[int | None]
    words: list[int]
    shingles: list[np.ndarray]
    marks: list[np.uint64]
    buckets: dict[tuple[int, int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], shingle: int = SHINGLE) -> Items:
        rows = [(i, normalised(t)) for i, t in rows]
        out = cls([], [], [], [])
        for first, texts in blocks([t for _, t in rows]):
            b = Block(texts, _GAPS)
            for k in range(b.n):
                lo, hi = b.words_upto[k], b.words_upto[k + 1]
                if hi > lo:
                    width = min(shingle, int(hi - lo))
                    h = _windows(b.words[lo:hi], width)
                    out.ids.append(rows[first + k][0])
                    out.words.append(int(hi - lo))
                    out.shingles.append(h)
                    out.marks.append(_packed(_bits(h).sum(0)[None])[0])
        return out

    @cached_property
    def known(self) -> dict[int, np.ndarray]:
        """Sorted shingles of the items, by the number of words in a shingle."""
        by: dict[int, list[np.ndarray]] = defaultdict(list)
        for n, h in zip(self.words, self.shingles, strict=True):
            by[min(SHINGLE, n)].append(h)
        return {w: np.unique(np.concatenate(h)) for w, h in by.items()}

    @cached_property
    def of_length(self) -> dict[int, np.ndarray]:
        """Sorted shingles of the items of each length."""
        return {n: np.unique(np.concatenate([self.shingles[k] for k in items])) for n, items in self.lengths.items()}

    @cached_property
    def sieve(self) -> dict[int, np.ndarray]:
        """For each width, 2**20 flags by the low bits of its shingles: most others fail at one look."""
        out = {}
        for w, h in self.known.items():
            out[w] = np.zeros(1 << 20, bool)
            out[w][(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return out

    @cached_property
    def lengths(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = defaultdict(list)
        for k, n in enumerate(self.words):
            out[n].append(k)
        return dict(out)

    @cached_property
    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]]:
        """For each length its items, their fingerprints, and for each block the places of the items by the block's value."""
        out = {}
        for n, items in self.lengths.items():
            marks = np.array([self.marks[k] for k in items], np.uint64)
            blocks = []
            for t in range(TABLES):
                value = (marks >> np.uint64(t * _SIZE)) & np.uint64((1 << _SIZE) - 1)
                order = np.argsort(value, kind="stable").astype(np.int32)
                blocks.append(np.split(order, np.searchsorted(value[order], np.arange(1, 1 << _SIZE))))
            out[n] = np.array(items), marks, blocks
        return out

    def bucket(self, n: int, table: int, value: int) -> np.ndarray:
        """Places of the items of ``n`` words whose block is at most RADIUS // TABLES bits from ``value``; gathered when first asked for."""
        key = n, table, value
        if key not in self.buckets:
            self.buckets[key] = np.concatenate([self.tables[n][2][table][v] for v in _NEAR[value]])
        return self.buckets[key]

    def near(self, n: int, mark: np.uint64, shingles: int) -> tuple[np.ndarray, np.ndarray]:
        """Items of ``n`` words whose fingerprints are within the radius, and how far they are; all of them where there are few shingles."""
        items, marks, _ = self.tables[n]
        if shingles < FEW:
            return items, np.bitwise_count(marks ^ mark)
        met = np.zeros(len(items), bool)
        for t in range(TABLES):
            met[self.bucket(n, t, int(mark) >> (t * _SIZE) & ((1 << _SIZE) - 1))] = True
        apart = np.bitwise_count(marks ^ mark)
        met &= apart <= RADIUS
        return items[met], apart[met]

    @cached_property
    def counted(self) -> list[Counter]:
        return [Counter(h.tolist()) for h in self.shingles]


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    h = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)]
    return h ^ (h >> np.uint64(29))


def search(words: np.ndarray, hits: dict[int, np.ndarray], hashes: dict[int, np.ndarray], items: Items, least: float = SIMILARITY) -> list[tuple[int, float, int, int]]:
    """(item, similarity, first word, bits apart) of the best window of each item that some window reaches."""
    best: dict[int, tuple[float, int, int]] = {}
    upto: dict[int, np.ndarray] = {}
    places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in items.lengths:
        width = min(SHINGLE, n)
        # a shorter document is its own one window
        m = min(n, len(words)) - width + 1
        enough = least / (1 + least) * (m + n - width + 1) - 1e-9
        if width not in places:
            at = np.flatnonzero(hits[width])
            places[width] = at, hashes[width][at]
        at, value = places[width]
        if m < 1 or len(at) < enough:
            continue
        shingles = items.of_length[n]
        at = at[shingles[np.minimum(np.searchsorted(shingles, value), len(shingles) - 1)] == value]
        if len(at) < enough:
            continue
        known = np.zeros(len(hashes[width]) + 1, np.int32)
        known[at + 1] = 1
        np.cumsum(known, out=known)
        start = np.flatnonzero((known[m:] - known[:-m]) >= enough)
        if not len(start):
            continue
        if width not in upto:
            upto[width] = np.zeros((len(hashes[width]) + 1, 64), np.int32)
            np.cumsum(_bits(hashes[width]), axis=0, out=upto[width][1:])
        marks = upto[width]
        marked = _packed(marks[start + m] - marks[start])
        for s, mark in zip(start.tolist(), marked, strict=True):
            own = None
            for k, apart in zip(*(x.tolist() for x in items.near(n, mark, min(m, n - width + 1))), strict=True):
                if best.get(k, (0.0,))[0] >= 1:
                    continue
                own = own or Counter(hashes[width][s : s + m].tolist())
                got = similarity(own, items.counted[k])
                if got >= least and got > best.get(k, (0.0,))[0]:
                    best[k] = (got, s, apart)
    return [(k, *v) for k, v in sorted(best.items())]


def _matches(docs: DataFrame, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(sent.value)
        for batch in sliced(batches):
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for first, texts in blocks([normalised(t) for t in batch.column(1).to_pylist()]):
                b = Block(texts, _GAPS)
                found = {}
                for w, known in items.known.items():
                    h = _windows(b.words, w)
                    sure = np.flatnonzero(items.sieve[w][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    hit = np.zeros(len(h), bool)
                    hit[sure] = known[np.minimum(np.searchsorted(known, h[sure]), len(known) - 1)] == h[sure]
                    found[w] = h, hit
                at = np.unique(np.concatenate([b.doc[: len(hit)][hit] for _, hit in found.values()])) if found else []
                for d in at:
                    lo, hi = b.words_upto[d], b.words_upto[d + 1]
                    own = {w: slice(lo, max(lo, hi - w + 1)) for w in found}
                    for k, *rest in search(b.words[lo:hi], {w: found[w][1][s] for w, s in own.items()}, {w: found[w][0][s] for w, s in own.items()}, items):
                        out.append((ids[first + d], items.ids[k], *rest))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (batch.column(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "similarity", "start_word", "bits_apart"])

    asked = docs.select("doc_id", "text")
    return asked.mapInArrow(run, f"doc_id {asked.dtypes[0][1]}, item_id long, similarity double, start_word long, bits_apart int")


def contaminated(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, bits_apart``: each item that a row of ``docs`` holds.

    Words are runs of letters and digits, lower-cased.  A row is returned when
    some window of as many words as the item has a weighted Jaccard similarity
    of five-word shingles of 0.8 or more; it tells the most similar such
    window, the first on a tie.  Windows and items of 16 shingles or more meet
    when their SimHashes are within 24 bits, which one in millions of such
    windows is not.  A row of fewer words
    than the item is one window as a whole.  An item of fewer than
    five words is one shingle.  Null and wordless texts and items match
    nothing; repeated rows and items are matched one by one; null ids are kept;
    an empty table gives an empty result; other columns are ignored.

    The benchmark is read in blocks of about ``items_at_once``, and of about
    BYTES_AT_ONCE, each one pass over the documents, so what is sent out has a
    bound that does not grow with the benchmark.
    """
    wanted = benchmark.select("item_id", "text")
    told = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    if not told["n"]:
        return _matches(docs.limit(0), [])
    passes = max(-(-told["n"] // items_at_once), -(-told["size"] // BYTES_AT_ONCE))
    out = None
    for k in range(passes):
        block = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        part = _matches(docs, [(r["item_id"], r["text"]) for r in block.toLocalIterator()])
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, whatever their ids; only rows that may go are shuffled."""
    body = F.unhex(F.md5("text"))
    found = cut(contaminated(docs.select(body.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("body")).distinct())
    touched, untouched = needed(docs, body, found)
    packed = touched.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    free = packed.join(found, F.unhex(F.md5("row.text")) == F.col("body"), "left_anti")
    return untouched.union(free.select("row.*"))
