"""Blocked Bloom filters: built by Spark from a column of hashes, probed with numpy.

A block is 256 bits; a hash sets one bit in each of its block's eight words.  Sixteen bits
per hash, at most ``MOST_BYTES`` for the whole filter: with more hashes it lets more through,
and what it lets through is always joined exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 8 << 20
_WORDS, _WORD_BITS = 8, 32
_LOW = 0xFFFFFFFF
#: Odd numbers below 2**31, so that products stay within 63 bits.
_SALTS = [((0x9E3779B1 * (2 * i + 1)) & 0x7FFFFFFF) | 1 for i in range(_WORDS)]


def build_filter(keys: DataFrame, hashed: Column) -> np.ndarray:
    """Blocks of a filter over the 64-bit hashes of ``keys``; the driver gets at most MOST_BYTES of bits."""
    bits = _WORDS * _WORD_BITS
    blocks = max(1, min(MOST_BYTES * 8 // bits, -(-16 * keys.count() // bits)))
    low = hashed.bitwiseAND(F.lit(_LOW))
    block = F.shiftrightunsigned(hashed, 32) % blocks
    places = F.array(*[
        F.struct(block.alias("block"), F.lit(w).alias("word"),
                 F.shiftright((low * F.lit(salt)).bitwiseAND(F.lit(_LOW)), 27).cast("int").alias("bit"))
        for w, salt in enumerate(_SALTS)
    ])
    words = (
        keys.select(F.explode(places).alias("b")).select("b.*")
        .groupBy("block", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    out = np.zeros((blocks, _WORDS), dtype=np.uint64)
    found = words.toPandas()
    out[found["block"].to_numpy(np.int64), found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint64)
    return out.astype(np.uint32)


def might_hold(blocks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may have been among those of the filter."""
    hashes = hashes.astype(np.uint64, copy=False)
    block = (hashes >> np.uint64(32)) % np.uint64(len(blocks))
    low = hashes & np.uint64(_LOW)
    passes = np.ones(len(hashes), dtype=bool)
    for w, salt in enumerate(_SALTS):
        bit = ((low * np.uint64(salt)) & np.uint64(_LOW)) >> np.uint64(27)
        passes &= (blocks[block, w] >> bit.astype(np.uint32) & np.uint32(1)).astype(bool)
    return passes


def keep_possible(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among the same column of ``keys``; a join has to follow."""
    blocks = build_filter(keys, F.xxhash64(key))

    @F.pandas_udf("boolean")
    def possible(hashes: pd.Series) -> pd.Series:
        return pd.Series(might_hold(blocks, hashes.to_numpy().view(np.uint64)))

    return df.filter(possible(F.xxhash64(key)))
