"""Sideways pruning: what a small, filtered table says about a large one.

``id_bitmap`` hashes the keys of the small side into a bitmap of a fixed number of
bits, kept as 64-bit words: at most ``bits / 64`` rows however many keys there are, so
its broadcast has a bound. ``prune`` drops the rows of the large side whose bit is not
set, right after the scan and before any shuffle. A row may pass by a collision, so the
exact join still follows; none is lost.

With n keys a foreign row passes with a probability below n / bits: the filter is worth
its broadcast while n is small against ``bits``, and harmless beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^25 bits: at most 524 288 words, about 20 MB in a broadcast.
BITS = 1 << 25


def _place(key: str, bits: int) -> tuple[Column, Column]:
    """The word of a key, and the bit in it."""
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def id_bitmap(ids: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """_word, _set: the bitmap of the non-NULL values of ``key``."""
    word, bit = _place(key, bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return (ids.filter(F.col(key).isNotNull())
            .groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_set")))


def prune(df: DataFrame, key: str, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose key may be in the bitmap; rows without key go."""
    word, bit = _place(key, bits)
    kept = df.filter(F.col(key).isNotNull()).withColumn("_word", word).join(F.broadcast(bitmap), "_word")
    return kept.filter(F.getbit("_set", bit) == 1).drop("_word", "_set")
