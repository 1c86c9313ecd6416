"""Chat formatting at token level.

A turn becomes ``START role SEP text END``.  START, SEP and END are ids beyond
the tokenizer's vocabulary, so no text can encode to them; role and text are
encoded each on its own.  Where a rendered template is needed, the three stand
as ``<|im_start|>``, ``<|im_sep|>`` and ``<|im_end|>``; their spelling inside a
text is escaped, reversibly, so that a rendered conversation parses one way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: A reversible byte-level vocabulary; reserved ids lie beyond its last one.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
START, SEP, END = 50257, 50258, 50259
SPELLED = {START: "<|im_start|>", SEP: "<|im_sep|>", END: "<|im_end|>"}
#: The role whose texts carry loss.
LEARNED = "assistant"

TURNS = "conv_id long, turn long, role string, ids array<int>, loss array<byte>"


def escape(text: str) -> str:
    """Put a backslash more between ``<`` and ``|``: no ``<|`` is left, and nothing is lost."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def load(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def assemble(tokenizer: Tokenizer, roles: list[str], texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and loss masks of some turns.

    Segments are laid end to end; the mask is the running sum of +1 where a
    learned segment starts and -1 where it ends.
    """
    n = len(texts)
    both = tokenizer.encode_batch([escape(x) for pair in zip(roles, texts, strict=True) for x in pair], add_special_tokens=False)
    coded = [e.ids for e in both]
    size = np.zeros((n, 5), np.int64)
    size[:, [0, 2, 4]] = 1
    size[:, 1] = [len(x) for x in coded[0::2]]
    size[:, 3] = [len(x) for x in coded[1::2]]
    upto = np.concatenate(([0], np.cumsum(size.ravel())))
    flat = np.empty(upto[-1], np.int32)
    for k, reserved in ((0, START), (2, SEP), (4, END)):
        flat[upto[np.arange(n) * 5 + k]] = reserved
    for k in (1, 3):
        for i, ids in enumerate(coded[k // 2 :: 2]):
            at = upto[i * 5 + k]
            flat[at : at + len(ids)] = ids
    steps = np.zeros(upto[-1] + 1, np.int32)
    learned = np.flatnonzero(np.array([r == LEARNED for r in roles], bool)) * 5 + 3
    np.add.at(steps, upto[learned], 1)
    np.add.at(steps, upto[learned + 1], -1)
    mask = np.cumsum(steps[:-1]).astype(np.int8)
    ends = upto[np.arange(n + 1) * 5]
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], [mask[a:b] for a, b in zip(ends, ends[1:], strict=False)]


#: Turns, and characters of them, that are encoded at once; a longer turn is encoded alone.
SLICE_TURNS, SLICE_CHARS = 1000, 1 << 22


def slices_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of turns within the bounds."""
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and (held + size > SLICE_CHARS or i - first >= SLICE_TURNS):
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def format_turns(conversations: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``conv_id, turn, role, ids, loss`` for every row: its tokens and their loss mask.

    A narrow pass; turns are encoded where they lie.  A null role or text is
    empty; other columns are ignored; repeated rows stay repeated.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(path)
        for frame in frames:
            sizes = frame["text"].str.len().to_numpy()
            for at, end in slices_of(sizes):
                some = frame.iloc[at:end]
                ids, loss = assemble(tokenizer, list(some["role"]), list(some["text"]))
                yield pd.DataFrame({"conv_id": some["conv_id"].astype("Int64"), "turn": some["turn"].astype("Int64"), "role": some["role"], "ids": ids, "loss": loss})

    filled = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return filled.mapInPandas(encode, TURNS)


def parse(tokenizer: Tokenizer, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str]:
    """(role, text, text under the loss mask) of one formatted turn, unescaped."""
    sep, end = np.flatnonzero(ids == SEP)[0], len(ids) - 1
    if ids[0] != START or ids[end] != END:
        raise ValueError("not a formatted turn")
    read = lambda x: unescape(tokenizer.decode(x.tolist(), skip_special_tokens=False))
    return read(ids[1:sep]), read(ids[sep + 1 : end]), read(ids[loss.astype(bool)])


def render(tokenizer: Tokenizer, ids: np.ndarray) -> str:
    """The template as text, control strings spelled out."""
    sep = np.flatnonzero(ids == SEP)[0]
    read = lambda x: tokenizer.decode(x.tolist(), skip_special_tokens=False)
    return SPELLED[START] + read(ids[1:sep]) + SPELLED[SEP] + read(ids[sep + 1 : -1]) + SPELLED[END]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(turns: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per conversation, read back from formatted turns.

    The turns of a conversation meet sorted in one partition and are folded one
    by one: what is held is a pair of running hashes, whatever the length.
    Turns with one number are ordered by role, then ids.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, rows, open_ = load(path), [], None
        for frame in frames:
            for conv, ids, loss in zip(frame["conv_id"], frame["ids"], frame["loss"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if open_ is None or open_[0] != conv:
                    if open_:
                        rows.append(close(open_))
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, loss = np.asarray(ids), np.asarray(loss)
                role, text, learned = parse(tokenizer, ids, loss)
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
                open_[3] += len(learned)
                open_[4].update(learned.encode())
                open_[5] += len(render(tokenizer, ids))
            if rows:
                yield shape(rows)
                rows = []
        if open_:
            yield shape([close(open_)])

    def close(x: list) -> list:
        return [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]

    def shape(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids").mapInPandas(fold, DIGEST)
