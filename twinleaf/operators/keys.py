"""Bit tables of keys: rows that can't be wanted stay where they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a table at most: 16 MB.
MOST_BITS = 27


def slot_of(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots))


def bit_table(keys: DataFrame) -> tuple[np.ndarray, int]:
    """The slots of the keys (one column) as bits, 16 for each key as far as there is room, and the number of slots."""
    size = 1 << min(MOST_BITS, max(10, (16 * keys.count() - 1).bit_length()))
    words = keys.select(slot_of(F.col(keys.columns[0]), size).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("v")).toPandas()
    bits = np.zeros(size >> 6, dtype=np.uint64)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits, size


def in_bits(bits: np.ndarray, slot: pa.Array) -> np.ndarray:
    """Whether each slot is in the table."""
    at = slot.to_numpy(zero_copy_only=False)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def among(key: Column, keys: DataFrame) -> Column:
    """True for every key that keys (one column) has, and for few others: a join must follow. Only the keys' slots go to Python."""
    bits, size = bit_table(keys)

    @F.arrow_udf("boolean")
    def hit(slot: pa.Array) -> pa.Array:
        return pa.array(in_bits(bits, slot))

    return hit(slot_of(key, size))
