"""Best-fit packing of tokenised documents into fixed-length sequences.

Lengths are small integers, so one histogram of them, of at most ``capacity``
rows whatever the corpus, holds all that packing needs.  The driver packs the
histogram in runs ("so many bins of this pattern"); each piece then finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netloom.llm.textops import memory_of
from netloom.operators.ranking import gapless_rank
from netloom.plans.session import cut, small_batches

CAPACITY = 2048
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Id put after each document.
CLOSING = 0
#: Words that a worker remembers the ids of, and words that it encodes at once.
REMEMBERED, AT_ONCE = 800_000, 4000
#: A plan of more rows than this is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 200_000


class Coder:
    """Encodes whole texts through a memory of words.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its words, laid end to end.  New words are encoded together,
    between separators that stand for a single id.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.memory: dict[str, bytes] = {"": b""}
        self.mark = self.tokenizer.encode("0", add_special_tokens=False).ids

    def learn(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if "0" not in w]
        found = {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words if "0" in w}
        for at in range(0, len(plain), AT_ONCE):
            some = plain[at : at + AT_ONCE]
            ids = np.array(self.tokenizer.encode(" 0 ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else []
            if len(cuts) == len(some) - 1:
                ends, raw, begin = [*(4 * cuts).tolist(), 4 * len(ids)], ids.tobytes(), 0
                for w, end in zip(some, ends, strict=True):
                    found[w] = raw[begin:end]
                    begin = end + 4
            else:
                found |= {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in some}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [re.sub(r"[\t\r\n\x0b\x0c]", " ", t).split(" ") for t in texts]
        new = {w for words in parts for w in words if w not in self.memory}
        extra = self.learn(list(new)) if new else {}
        room = REMEMBERED - len(self.memory)
        if len(extra) <= room:
            self.memory |= extra
            look = self.memory.__getitem__
        else:
            look = lambda w: self.memory.get(w) or extra.get(w, b"")
        return [b"".join(map(look, words)) for words in parts]


def coder(path: str) -> Coder:
    coders = memory_of("packing")
    if path not in coders:
        coders[path] = Coder(path)
    return coders[path]


def tokenise(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs``: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document's ids end with id 0; only a document of more than ``capacity``
    ids is cut, every ``capacity`` ids.  A null or empty text is id 0 alone.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    closing = np.array([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                out: list[list] = [[] for _ in names]
                for doc, raw in zip(some.column(0).to_pylist(), code.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    raw += closing
                    for piece, begin in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[begin : begin + 4 * capacity]
                        row = [doc, piece, begin // 4, len(part) // 4, zlib.crc32(part)]
                        for column, value in zip(out, [*row, np.frombuffer(part, "<u4").astype(np.int32)] if keep_ids else row, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``{length: count}``: rows ``(length, first rank, end rank, first bin, items a bin, offset)``.

    Lengths above a third of the capacity are matched first, the longest with
    the longest that still fits beside it, at most two to a bin.  The others,
    longest first, go to the bin whose gap is the smallest that holds them.
    Bins of one gap are handled in runs, so the work depends on the number of
    lengths, not of pieces.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    bins = 0
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((first, n))

    left = {k: n for k, n in histogram.items() if n > 0}
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        length = large[-1]
        fits = bisect_left(large, capacity - length + 1) - 1
        mate = large[fits] if fits >= 0 else None
        if mate is None:
            n = left[length]
            put(length, n, bins, 1, 0)
        elif mate == length:
            n = left[length] // 2
            if n:
                put(length, 2 * n, bins, 2, 0)
                left[length] -= n
            else:
                mate, n = None, 1
                if fits:
                    mate = large[fits - 1]
                    put(mate, 1, bins, 1, length)
                    left[mate] -= 1
                put(length, 1, bins, 1, 0)
        else:
            n = min(left[length], left[mate])
            put(length, n, bins, 1, 0)
            put(mate, n, bins, 1, length)
            left[mate] -= n
        leave(capacity - length - (mate or 0), bins, n)
        bins += n
        left[length] -= n
        for k in {length, mate} - {None}:
            if not left[k]:
                large.remove(k)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        need = left[length]
        while need:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                gap, first, n = capacity, bins, -(-need // (capacity // length))
                bins += n
            else:
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    gaps.pop(at)
            each = gap // length
            full = min(n, need // each)
            if full:
                put(length, full * each, first, each, capacity - gap)
                leave(gap - each * length, first, full)
                need -= full * each
            if full < n and need:
                put(length, need, first + full, need, capacity - gap)
                leave(gap - need * length, first + full, 1)
                full, need = full + 1, 0
            leave(gap, first + full, n - full)
    return rows


PLAN = "p_length long, p_from long, p_to long, p_bin long, p_each long, p_offset long"


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Ranks are dealt in ranges of a hash, so a length that a third of all pieces
    have is still handled by many tasks.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = plan(histogram, capacity)
    table = spark.createDataFrame(rows, PLAN)
    if len(rows) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    ranked = gapless_rank(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], "_rank")
    here = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to"))
    at = F.col("_rank") - F.col("p_from")
    return ranked.join(table, here).select(
        *pieces.columns,
        (F.col("p_bin") + F.floor(at / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + F.pmod(at, F.col("p_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` (``doc_id``, ``text``) and place every piece.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32`` (and
    ``ids``) with ``sequence_id`` and ``offset``; a sequence is filled without
    gaps from 0.  Rows with equal ids and texts are packed one by one, as are
    null ids; other columns are ignored; an empty table gives an empty result.
    Texts are tokenised once and the pieces written to the shared folder, as
    both the histogram and the placing read them.
    """
    return place(cut(tokenise(docs, capacity, path, keep_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from pieces packed with ``keep_ids``: at most ``capacity`` ids each."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
