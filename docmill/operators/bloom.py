"""Bloom filters as a reduction before joins: the large side is cut down by a filter of the small one, then joined exactly."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a filter may have in the driver and in each task.
MOST_BYTES = 16 << 20
#: Wrongly held keys among those that aren't there, and the hashes that reach it with the fewest bits.
FALSE_RATE = 0.01
HASHES = 7


@dataclass
class Bloom:
    """``bits`` as 64-bit words."""

    bits: np.ndarray

    def may_hold(self, key: Column) -> Column:
        """False for keys that the filter doesn't hold; null keys aren't held. Only a hash of each key goes to Python, in batches."""
        bits = self.bits

        @F.pandas_udf(T.BooleanType())
        def held(h: pd.Series) -> pd.Series:
            return pd.Series(all_set(bits, h.to_numpy(np.int64)))

        return F.when(key.isNull(), F.lit(False)).otherwise(held(F.xxhash64(key)))


def all_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set; two halves of it make them."""
    low, high = h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF
    out = np.ones(len(h), bool)
    for k in range(HASHES):
        at = (low + k * high) % (64 * len(bits))
        out &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return out


def size_for(n: int) -> int:
    """Words for ``n`` keys."""
    return max(1, math.ceil(n * -math.log(FALSE_RATE) / math.log(2) ** 2 / 64))


def build(df: DataFrame, key: str, n: int | None = None) -> Bloom | None:
    """The filter of the keys of ``df``; None if it would be larger than ``MOST_BYTES``.

    Tasks set bits by word and merge them by an aggregation that is combined before the
    shuffle, whatever the number of equal keys; the words come to the driver.
    """
    n = df.count() if n is None else n
    words = size_for(n)
    if 8 * words > MOST_BYTES:
        return None
    low, high = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32)
    at = F.explode(F.array(*[(low + F.lit(k).cast("long") * high) % F.lit(64 * words).cast("long") for k in range(HASHES)]))
    bits = df.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")).select(at.alias("at"))
    merged = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).collect()
    out = np.zeros(words, np.int64)
    for r in merged:
        out[r["word"]] = r["bits"]
    return Bloom(out)


def anti_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``, as an anti join gives them.

    Of ``right``, the large side, those rows are shuffled that the filter of ``left`` may
    hold: its keys that are there, and a hundredth of the others. If ``left`` is too large
    for a filter, this is the plain join.
    """
    keys = right.select(key).where(F.col(key).isNotNull())
    bloom = build(left, key)
    return left.join(keys.where(bloom.may_hold(F.col(key))) if bloom else keys, key, "left_anti")
