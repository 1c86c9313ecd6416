"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netloom.llm.textops import Block, blocks, sliced

#: Highest share of the words' characters inside repeated n-grams, by n, and inside repeated lines.
GRAM_SHARES = {5: 0.35, 8: 0.30, 10: 0.25}
LINE_SHARE = 0.30
#: The base rule: fewest words, and the highest share of words in repeated three-word windows.
LEAST_WORDS, WINDOW, REPEAT_SHARE = 50, 3, 0.5
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + "".join(f"gram{n}_share double, " for n in GRAM_SHARES)
    + "line_share double, base_failed boolean, kept boolean"
)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts, shares and verdicts of some UTF-8 texts."""
    b = Block(texts)
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS)] = True
    symbols = np.concatenate(([0], np.cumsum(marks[b.bytes])))
    out = {
        "n_words": b.n_words,
        "word_chars": b.per_text(b.points),
        "n_symbols": symbols[b.firsts + b.sizes] - symbols[b.firsts],
        "n_repeat_words": b.per_text(b.repeated(WINDOW)),
    }
    whole = np.maximum(out["word_chars"], 1)
    good = np.ones(b.n, bool)
    for n, most in GRAM_SHARES.items():
        out[f"gram{n}_share"] = b.per_text(b.points * b.repeated(n)) / whole
        good &= out[f"gram{n}_share"] <= most
    doc, starts, ends = b.lines
    later = b.later_copies()
    out["n_dup_lines"] = np.bincount(doc[later], minlength=b.n)
    copied = Block.twice(doc, b.hash(starts, ends))
    upto = np.concatenate(([0], np.cumsum(b.points)))
    chars = upto[np.searchsorted(b.starts, ends)] - upto[np.searchsorted(b.starts, starts)]
    out["line_share"] = np.bincount(doc[copied], weights=chars[copied], minlength=b.n) / whole
    good &= out["line_share"] <= LINE_SHARE
    out["base_failed"] = (b.n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > 100 * REPEAT_SHARE * b.n_words)
    out["kept"] = good & ~out["base_failed"]
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in sliced(batches):
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for first, some in blocks(texts):
            got = measure(some)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some))] + [pa.array(got[n].astype(np.int64) if got[n].dtype.kind in "iu" else got[n]) for n in names[1:]], names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, repetition shares and verdict of every row of ``docs`` (``doc_id``, ``text``).

    Words are runs of characters other than space and ``\\x09``-``\\x0d``.
    ``base_failed``: too few words, or too many of them in repeated three-word
    windows.  ``kept``: not that, and no share of characters inside repeated
    n-grams or lines above its limit.  A null or empty text has no words, so it
    fails; rows are judged one by one, so repeated rows get equal results; an
    empty table gives an empty result; other columns are ignored.  One narrow
    pass: no shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(_batches, SCHEMA)
