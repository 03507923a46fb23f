"""Set filters of a bounded size, built by Spark and sent to Python workers.

A filter only spares work: rows that it lets through by mistake are told apart by an exact step later. Its
size is a parameter, which ``bits_for`` derives from the number of keys up to a bound, so the broadcast does not
grow with the data beyond that; more keys make it let more rows through.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.sources.staging import freeing

#: Bits of a filter: 8 MB.
BITS = 26
#: Bits for each key, and the most bits of a filter that is sized by its keys: 64 MB.
KEY_BITS = 8
MOST_BITS = 29
#: Bits of one bitmap that Spark's aggregate builds.
BUCKET = 15


def bits_for(keys: int) -> int:
    """The size of a filter of so many keys; up to some 6 * 10**7 of them it lets one other key in 20 through at most."""
    return min(max((keys * KEY_BITS - 1).bit_length(), BITS), MOST_BITS)


def build(keys: DataFrame, key: str, bits: int = BITS) -> Broadcast:
    """The filter of well mixed 64-bit keys, as bytes; null keys are not in it.

    Two bits stand for a key. The driver gets the filter itself, 2**bits / 8 bytes at most.
    """
    low = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    high = F.shiftrightunsigned(F.col(key), 64 - bits)
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    width = 1 << (BUCKET - 3)
    with freeing(keys.sparkSession):
        places = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(low, high)).alias("place"))
        buckets = (
            places.select(F.shiftright("place", BUCKET).alias("bucket"), F.col("place").bitwiseAND(F.lit((1 << BUCKET) - 1)).alias("bit"))
            .repartition("bucket")
            .groupBy("bucket")
            .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        )
        for row in buckets.collect():
            table[row["bucket"] * width : (row["bucket"] + 1) * width] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.tobytes())


def holds(table: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each unsigned 64-bit key may be in the filter."""
    found = np.frombuffer(table, dtype=np.uint8)
    bits = len(found).bit_length() + 2
    out = np.ones(len(keys), dtype=bool)
    for place in (keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)):
        out &= (found[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
