"""Joins of many rows with few, or with one row per key where some keys hold a great share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with over 1 / SHARE of all rows is joined by broadcast; there can be no more than SHARE of these.
SHARE = 1000
#: With fewer rows than this a plain join does.
FEW_ROWS = 4096
#: Bits for each key in the filter that tells which rows a join needs, how many of them a key sets, and the
#: words of 64 bits that the filter has at most: those of eleven million keys.
KEY_BITS, SET_BITS, MOST_WORDS = 12, 3, 1 << 21


def join_by_key(rows: DataFrame, one: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``one``, which holds one row per key and in ``n`` how many of ``rows`` have it.

    ``total`` is at least the number of ``rows``.  Keys with over 1 / SHARE of
    it are broadcast, so their rows stay where they are; as there are at most
    SHARE such keys, what is broadcast has a fixed bound.  All other keys meet
    in a shuffled join, where none is large.  Null keys match nothing.
    """
    if total < FEW_ROWS:
        return rows.join(one.drop(n), on)
    often = F.col(n) * SHARE > F.lit(total)
    hub = F.broadcast(one.where(often))
    stay = rows.join(hub.drop(n), on)
    move = rows.join(hub.select(*on), on, "left_anti").join(one.where(~often).drop(n), on)
    return stay.unionByName(move)


def needed(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be in ``keys``, a frame of one column, and rows whose key is not.

    The keys are folded into a Bloom filter that is sized by their number and
    built by ranges of the hash, a word of 64 bits for each range, so that a
    key costs one look.  About one row in fifty passes without need.  What is
    broadcast has MOST_WORDS words for any number of keys; the fuller these
    get the fewer rows they rule out.  A join must follow in any case.
    """
    words = 1 << max(10, min(MOST_WORDS.bit_length() - 1, (keys.count() * KEY_BITS // 64).bit_length()))
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(words))
    one = lambda c, k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(F.xxhash64(c), 22 + 7 * k), F.lit(64)).cast("int"))
    bits = lambda c: reduce(Column.bitwiseOR, [one(c, k) for k in range(SET_BITS)])
    own = F.col(keys.columns[0])
    held = keys.select(word(own).alias("w"), bits(own).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), key.alias("key"))
    told = packed.join(F.broadcast(held), word(F.col("key")) == F.col("w"), "left")
    hit = F.coalesce(F.col("b").bitwiseAND(bits(F.col("key"))) == bits(F.col("key")), F.lit(False))
    return told.where(hit).select("row.*"), told.where(~hit).select("row.*")
