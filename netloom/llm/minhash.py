"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity.

The first permutation takes a shingle's hash to a place on a circle, the second
one numbers the places; coordinate ``k`` of a signature is the least number
that a document's places have when the circle is turned by ``k``.  Turned
numbers of one place lie next to each other, so a signature is the element-wise
minimum of runs of one array.  Bands of coordinates are the keys by which
documents meet; the sets of shingles decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.textops import Block, blocks, mix, sliced
from netloom.operators.components import connected_components
from netloom.operators.hubs import join_by_key, needed
from netloom.operators.meetings import meeting, similar
from netloom.plans.session import cut, discard

WORDS, LEAST = 2, 80
#: Places on the circle, coordinates of a signature and coordinates of a band: at a similarity of 0.8 the
#: bands of a pair all differ with a chance of (1 - 0.8 ** 8) ** 64, under one in a hundred thousand.
PLACES, COORDINATES, BAND, SEED = 1 << 20, 512, 8, 7
#: Of the signatures' low bits so many may differ before the sets are read: seven standard deviations at a similarity of 0.8.
SKETCH_BITS = 100
#: Strays and members of a large component that are held against each other at once.
TILE = 512
_RUN = 256


@cache
def _turned(seed: int = SEED) -> np.ndarray:
    """Row ``i``: the numbers of place ``i`` on the circle turned by 0, 1, .. COORDINATES - 1; a view of one permutation."""
    number = np.random.default_rng(seed).permutation(PLACES).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((number, number[: COORDINATES - 1])), COORDINATES)


def places(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: of 64-bit values, by their highest bits."""
    return (mix(shingles + np.uint64(SEED)) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The coordinates of a set of shingles that is not empty."""
    at, rows = places(shingles), _turned()
    out = rows[at[:_RUN]].min(0)
    for i in range(_RUN, len(at), _RUN):
        np.minimum(out, rows[at[i : i + _RUN]].min(0), out=out)
    return out


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one, without words there is none."""
    b = Block([t.lower() for t in texts])
    first, h = b.grams(words)
    upto = np.searchsorted(b.doc[first], np.arange(b.n + 1))
    out = []
    for k in range(b.n):
        n = int(b.n_words[k])
        if n >= words:
            out.append(np.unique(h[upto[k] : upto[k + 1]]))
        else:
            own = np.full(min(n, 1), n, np.uint64)
            for w in range(b.words_upto[k], b.words_upto[k + 1]):
                own = mix(own ^ b.words[w : w + 1])
            out.append(own)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band of each signature."""
    bands = signatures.astype(np.uint64).reshape(len(signatures), -1, BAND)
    h = np.arange(1, bands.shape[1] + 1, dtype=np.uint64)[None].repeat(len(bands), 0)
    for k in range(BAND):
        h = mix(h ^ bands[:, :, k])
    return h


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of 64-bit numbers."""
    ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel().view(np.int64)))


def marked(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, body, n, sid, keys, sketch`` of every row: hash of the text, size of the set, its hash, band keys and low bits.

    Where there is no shingle ``sid`` is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for at, texts in blocks([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]):
                sets = shingle_sets(texts, words)
                signed = np.stack([signature(s) if len(s) else np.zeros(COORDINATES, np.int32) for s in sets])
                sketch = np.packbits((signed & 1).astype(np.uint8), axis=1).view(np.uint64)
                sid = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                told = [pa.array([len(s) for s in sets], pa.int64()), pa.array(sid, pa.binary()), _lists(band_keys(signed)), _lists(sketch)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), *told], ["doc_id", "body", "n", "sid", "keys", "sketch"])

    asked = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("body"), "text")
    return asked.mapInArrow(run, f"doc_id {asked.dtypes[0][1]}, body binary, n long, sid binary, keys array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """``sid, shingles`` for each set of ``wanted`` (``sid, row_id, body``), made again from a row that has it; texts stay where they are."""
    body = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    mark = lambda i, b: F.xxhash64(i, b)
    rows = needed(docs.select(F.col("doc_id").alias("row_id"), body.alias("body"), "text"), mark(F.col("row_id"), F.col("body")), wanted.select(mark(F.col("row_id"), F.col("body"))))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for at, texts in blocks([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]):
                sets = shingle_sets(texts, words)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), values], ["row_id", "body", "shingles"])

    made = rows.mapInArrow(run, f"row_id {rows.dtypes[0][1]}, body binary, shingles array<long>").withColumnRenamed("row_id", "own_id").withColumnRenamed("body", "own_body")
    same = F.col("own_id").eqNullSafe(F.col("row_id")) & (F.col("own_body") == F.col("body"))
    # rows that are equal have equal sets; each task hands on one
    return made.join(wanted, same).groupBy("sid").agg(F.first("shingles").alias("shingles"))


def _alike(a: str, b: str, least: int) -> Column:
    """Whether sizes allow the similarity and sketches differ in few enough bits."""
    n, m = F.col(a)["n"], F.col(b)["n"]
    apart = sum((F.bit_count(F.col(a)[f"s{i}"].bitwiseXOR(F.col(b)[f"s{i}"])) for i in range(COORDINATES // 64)), F.lit(0))
    return (100 * F.least(n, m) >= least * F.greatest(n, m)) & (apart <= SKETCH_BITS)


def _tiles(rows: DataFrame, comp: DataFrame, own: str, other: str) -> DataFrame:
    """``rows`` (``id, comp``) dealt by hash to the chunks of their side, once for each chunk of the other."""
    chunk = F.pmod(F.xxhash64("id"), F.col(own)).alias(own)
    return rows.join(comp, "comp").select("comp", "id", chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other))


def settled(strays: DataFrame, members: DataFrame, full: DataFrame, least: int = LEAST) -> DataFrame:
    """``(a, b)``: links of strays to members of the component they met, one at most from each tile.

    A tile holds up to about TILE strays and TILE members of a component with
    their sets (``full``: ``sid, shingles``); it gives back links alone, so no
    row a pair is made.
    """
    n = strays.groupBy("comp").agg((F.floor(F.count("*") / TILE) + 1).alias("i"))
    m = members.groupBy("comp").agg((F.floor(F.count("*") / TILE) + 1).alias("j"))
    comp = cut(n.join(m, "comp"))
    sets = lambda c: full.select(F.col("sid").alias("id"), F.col("shingles").alias(c))

    def parts(table: pa.Table, of: str) -> tuple[list, np.ndarray, np.ndarray]:
        lists = table.column(of).combine_chunks()
        return table.column("id").to_pylist(), lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            ids, own, sizes = parts(left, "own")
            others, values, counts = parts(right, "held")
            first = np.cumsum(counts) - counts
            at = 0
            for i, size in zip(ids, sizes.tolist(), strict=True):
                x, at = own[at : at + size], at + size
                hit = x[np.minimum(np.searchsorted(x, values), size - 1)] == values
                shared = np.add.reduceat(hit, first, dtype=np.int64)
                linked = np.flatnonzero((100 + least) * shared >= least * (size + counts))
                if len(linked):
                    a.append(i)
                    b.append(others[linked[0]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    keys = ["comp", "i", "j"]
    left = _tiles(strays, comp, "i", "j").join(sets("own"), "id")
    right = _tiles(members, comp, "j", "i").join(sets("held"), "id")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(links, "a binary, b binary")


def set_links(docs: DataFrame, sets: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """``(a, b)``: links between different sets (``sid, row_id, body, n, keys, sketch``) whose similarity is ``least`` percent or more."""
    traits = F.struct("n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(COORDINATES // 64)])
    keyed = sets.select(F.explode(F.array_distinct("keys")).alias("key"), F.col("sid").alias("id"))
    met = meeting(keyed, sets.select(F.col("sid").alias("id"), traits.alias("t")))
    ids = met.select(F.col("id").alias("sid")).distinct()
    wanted = cut(sets.select("sid", "n", "row_id", "body").join(ids, "sid"))
    full = cut(full_sets(docs, wanted.select("sid", "row_id", "body"), words))

    def judge(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        side = lambda c: full.select(F.col("sid").alias(c), F.col("shingles").alias(f"x_{c}"))
        first = pairs.select("a", "salt").distinct().join(side("a"), "a")
        both = pairs.join(side("b"), "b").join(first, ["a", "salt"])
        shared = F.size(F.array_intersect("x_a", "x_b"))
        out = cut(both.where((100 + least) * shared >= least * (F.size("x_a") + F.size("x_b"))).select("a", "b"))
        discard(pairs)
        return out

    links = cut(similar(met, lambda a, b, _: _alike(a, b, least), judge, lambda strays, members: settled(strays, members, full, least)))
    discard(met, wanted, full)
    return links


def near_duplicates(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``).

    A document's set holds its distinct shingles of ``words`` words, A-Z
    lower-cased; with fewer words the whole sequence is its one shingle.
    Documents are linked when intersection over union is ``least`` percent or
    more; ``component_id`` is the smallest ``doc_id`` of the connected group and
    ``kept`` whether it is the row's own.  A document without words, null
    included, has no set and is linked with nothing.

    Rows with equal ids stay rows of their own; a null id keeps its row and
    names a group only where no row has an id; ties have no order to decide;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = cut(marked(docs, words))
    held = rows.where("sid is not null")
    sets = cut(held.groupBy("sid").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "body")).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    known = sets.select("sid", F.col("row.doc_id").alias("row_id"), F.col("row.body").alias("body"), "n", "keys", "sketch")
    group = connected_components(set_links(docs, known, words, least)).select(F.col("id").alias("sid"), "component")
    labelled = cut(sets.select("sid", "low", "copies").join(group, "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    named = labelled.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("kinds"))
    told = join_by_key(labelled, named, ["component"], "kinds", labelled.count()).select("sid", "copies", "component_id")
    linked = join_by_key(held.select("doc_id", "n", "sid"), told, ["sid"], "copies", held.count()).select("doc_id", "n", "component_id")
    lone = rows.where("sid is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(lone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
