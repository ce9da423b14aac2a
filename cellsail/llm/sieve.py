"""A sieve of fixed size: which of many keys may be in a set, before a shuffle brings the two together.

The bits come from one aggregate by word, whatever the number of keys, so at most
WORDS rows reach the driver and every task. With very many keys all bits are set
and everything passes; a join after the sieve is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits, a power of two: 4 MB.
WORDS = 1 << 19


def sieve(keys: DataFrame, key: str) -> Broadcast:
    """Bits of the hashes in column key, a long."""
    place = F.pmod(F.shiftright(key, 6), F.lit(WORDS))
    bit = F.expr(f"shiftleft(1L, CAST(`{key}` & 63 AS INT))")
    found = keys.groupBy(place.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(WORDS, dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set."""
    return (bits[(keys >> 6) & (WORDS - 1)] >> (keys & 63)) & 1 == 1


def maybe(bits: Broadcast, key: Column) -> Column:
    """Whether the hash key may be in the set."""

    @F.pandas_udf("boolean")
    def found(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, keys.to_numpy(np.int64)))

    return found(key)
