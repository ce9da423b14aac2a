"""The k-th smallest row by several whole-number keys, from counts of key digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a digit: each count has at most 2 ** DIGIT rows, and that many reach the driver.
DIGIT = 12
#: Added to longs, it makes them whole numbers from 0 in the same order.
_SIGN = 1 << 63


def _digit(key: str, shift: int) -> Column:
    return F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-_SIGN)), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))


def kth(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """Keys of the row at place k, from 1, in ascending order by all keys, which are longs without nulls.

    Key by key, and digit by digit from the first one in which the rows differ, the
    rows are counted by digit and only those of the digit that holds place k are
    looked at further. Counts are partial sums of tasks, so neither a common key
    nor equal rows meet anywhere. Of rows equal in all keys any is the k-th.
    """
    found: list[int] = []
    for key in keys:
        low, high = (x + _SIGN for x in rows.agg(F.min(key), F.max(key)).first())
        value, bits = low, (low ^ high).bit_length()
        while bits > 0:
            shift = max(0, bits - DIGIT)
            counts = rows.groupBy(_digit(key, shift).alias("digit")).agg(F.count("*").alias("n")).collect()
            for digit, n in sorted((r["digit"], r["n"]) for r in counts):
                if k <= n:
                    break
                k -= n
            rows = rows.filter(_digit(key, shift) == F.lit(digit))
            value = (value >> (shift + DIGIT) << (shift + DIGIT)) | (digit << shift)
            bits = shift
        found.append(value - _SIGN)
    return found


def up_to(keys: list[str], bound: list[int]) -> Column:
    """Whether a row's keys are at most bound, in their order."""
    parts, equal = [], F.lit(True)
    for key, b in zip(keys, bound):
        parts.append(equal & (F.col(key) < F.lit(b)))
        equal = equal & (F.col(key) == F.lit(b))
    return reduce(lambda a, b: a | b, parts, equal)
