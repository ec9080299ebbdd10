"""Sets of 64-bit hashes as bitmaps of a fixed size, built in Spark and sent to all tasks.

A bitmap only lets too much through: what it holds back is certainly not in the set.
Its size does not depend on the data; a full one costs time, never results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_bits(frame: DataFrame, position: Column, bits: int) -> np.ndarray:
    """Bytes of the bitmap in which each ``position`` (0 to 2**bits - 1) of the frame is set.

    At most 2**bits / 32768 rows of 4 KB reach the driver."""
    at = (position + F.lit(1)).cast("long")
    rows = (frame.select(at.alias("at"))
            .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))).toArrow()
    out = np.zeros((max(1, (1 << bits) >> 15), 4096), np.uint8)
    for bucket, piece in zip(rows.column(0).to_pylist(), rows.column(1)):
        out[bucket - 1] = np.frombuffer(piece.as_buffer(), np.uint8)
    return out.reshape(-1)


def holds(bitmap: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Which positions are set."""
    at = position.astype(np.int64, copy=False)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1
