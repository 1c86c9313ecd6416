"""Fill-in-the-middle by displacement scatter.

Cut points come from a scan for the ends of words.  A batch of texts is one
array of bytes; prefix, middle and suffix of a text each move by one distance.
These distances are written as differences where a part begins, a cumulative
sum gives every byte its own, and one scatter puts all bytes of the batch in
place.  The way back finds the markers in the output and gathers the bytes by
distances made the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.textops import Block, blocks, sliced

#: Fixed values of the format: what stands before prefix, suffix and middle.
MARKERS = (b"<P>", b"<S>", b"<M>")
#: Percent of the texts that are transformed, and of these the percent with the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
FORMS = np.array(["plain", "psm", "spm"], object)


def _draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def _markers(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(position, index in MARKERS) of every marker in the texts of a block."""
    text = block.bytes
    at = np.flatnonzero((text[:-2] == ord("<")) & (text[2:] == ord(">"))) if len(text) > 2 else np.zeros(0, np.int64)
    which = np.full(256, -1)
    which[[m[1] for m in MARKERS]] = range(len(MARKERS))
    kind = which[text[at + 1]]
    return at[kind >= 0], kind[kind >= 0]


def _distances(size: int, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """How far each of ``size`` bytes moves, for parts that begin at ``starts``, in order, and move by ``moves``; parts may be empty."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, np.diff(moves, prepend=0))
    return np.cumsum(step[:size])


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def scattered(texts: list[bytes], ids: list[int | None], rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> dict[str, np.ndarray | pa.Array]:
    """Units, form, characters of prefix and middle, and output of each text of a block."""
    b = Block(texts)
    first, last = b.firsts, b.firsts + b.sizes
    tail = (b.sizes > 0) & ~np.isin(last, b.ends)
    n = b.n_words + tail
    h = _draws(ids, seed)
    at, _ = _markers(b)
    marked = np.zeros(b.n, bool)
    marked[np.searchsorted(first, at, "right") - 1] = True
    form = np.where((b.sizes == 0) | marked | (h[:, 2] % 100 >= rate), 0, np.where(h[:, 3] % 100 < suffix_first, 2, 1))

    def cut(unit: np.ndarray) -> np.ndarray:
        """The byte where so many units end."""
        ends = np.append(b.ends, 0)[np.clip(b.words_upto[:-1] + unit - 1, 0, len(b.ends))]
        return np.where(unit == 0, first, np.where(unit > b.n_words, last, ends))

    low, high = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
    p = np.where(form == 0, last, cut(low))
    m = np.where(form == 0, last, cut(high))

    sizes = b.sizes + np.where(form == 0, 0, 9)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if b.n else np.zeros(0, np.int64)
    prefix, suffix = p - first, last - m
    to_prefix = begin + np.where(form == 0, 0, np.where(form == 1, 3, 6 + suffix))
    to_suffix = begin + np.where(form == 1, 6 + prefix, 3)
    to_middle = begin + 9 + prefix + suffix
    moves = np.stack((to_prefix - first, to_middle - p, to_suffix - m), axis=1)
    place = _distances(len(b.bytes), np.stack((first, p, m), axis=1).ravel(), moves.ravel())
    place += np.arange(len(b.bytes))
    own = np.ones(len(b.bytes), bool)
    own[last] = False
    out = np.empty(int(sizes.sum()), np.uint8)
    out[place[own]] = b.bytes[own]
    for k, where in enumerate((to_prefix, to_suffix, to_middle)):
        where = where[form > 0] - 3
        for i, byte in enumerate(MARKERS[k]):
            out[where + i] = byte
    chars = b.points_upto
    return {"n": n, "form": FORMS[form], "plain": form == 0, "prefix_chars": chars[p] - chars[first], "middle_chars": chars[m] - chars[p], "output": _strings(out, sizes)}


def gathered(outputs: list[bytes], forms: list[str | None]) -> pa.Array:
    """The texts that ``scattered`` made ``outputs`` of."""
    b = Block(outputs)
    known = {"psm": 1, "spm": 2}
    form = np.array([known.get(f or "plain", 0) for f in forms], np.int64)
    at, kind = _markers(b)
    doc = np.searchsorted(b.firsts, at, "right") - 1
    inside = form[doc] > 0
    at, kind, doc = at[inside], kind[inside], doc[inside]
    after = np.stack([b.firsts] * 3, axis=1)
    if not (np.bincount(doc, minlength=b.n)[form > 0] == 3).all():
        raise ValueError("an output does not hold each marker once")
    after[doc, kind] = at + 3
    last = b.firsts + b.sizes
    prefix = np.where(form == 0, b.sizes, np.where(form == 1, after[:, 1] - 3, after[:, 2] - 3) - after[:, 0])
    middle = np.where(form == 0, 0, last - after[:, 2])
    suffix = np.where(form == 0, 0, np.where(form == 1, after[:, 2] - 3, after[:, 0] - 3) - after[:, 1])
    sizes = prefix + middle + suffix
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if b.n else np.zeros(0, np.int64)
    to = np.stack((begin, begin + prefix, begin + prefix + middle), axis=1)
    come = np.stack((after[:, 0], after[:, 2], after[:, 1]), axis=1) - to
    whole = int(sizes.sum())
    # parts of a plain text that are empty begin where the next text does
    source = _distances(whole, np.minimum(to, whole).ravel(), come.ravel()) + np.arange(whole)
    return _strings(b.bytes[source], sizes)


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs`` (``doc_id``, ``text``).

    A unit is a word with the white space before it, and white space at the end
    is one more; ``n`` counts them.  Cuts, form and the share of texts that are
    transformed come from a hash of ``seed`` and ``doc_id``, so equal ids of
    equal texts give equal outputs, on any cluster; a null id draws as an empty
    one.  A text that is null or empty, or holds a marker, stays plain: ``output``
    is the text, empty for null, and the characters are null.  Texts are whole,
    of any length; rows are transformed one by one; an empty table gives an
    empty result; other columns are ignored.  One narrow pass: no shuffle.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column(0).to_pylist()
            for at, texts in blocks([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                got = scattered(texts, ids[at : at + len(texts)], rate, suffix_first, seed)
                chars = [pa.array(got[c], pa.int64(), mask=got["plain"]) for c in ("prefix_chars", "middle_chars")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(got["n"], pa.int64()), pa.array(got["form"], pa.string()), *chars, got["output"]], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``: the text, rebuilt from ``form`` and ``output`` alone.

    A null form is plain and a null output empty.  An output that says it is
    transformed and does not hold each marker once is an error.
    """
    kept = [c for c in rows.columns if c != "restored"]
    asked = rows.select(*[F.col(f"`{c}`") for c in kept], F.col("form").alias("_form"), F.col("output").alias("_output"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            forms = batch.column(len(kept)).to_pylist()
            for at, some in blocks([t or b"" for t in batch.column(len(kept) + 1).cast(pa.binary()).to_pylist()]):
                own = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*own.columns[: len(kept)], gathered(some, forms[at : at + len(some)])], [*kept, "restored"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in asked.dtypes[: len(kept)])
    return asked.mapInArrow(run, f"{kinds}, restored string")
