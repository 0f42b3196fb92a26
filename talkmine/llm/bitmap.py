"""A bitmap of fixed size over hashed ids: who is surely not among some ids, told inside any task.

It only spares the shuffle of rows that can't match; those that hit are joined exactly. Its size
doesn't depend on the data. When there are more ids than bits, more rows go on to that join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
_BUCKET = 32_768


def bitmap(ids: DataFrame) -> np.ndarray:
    """Bytes of the bitmap of a one-column table of longs."""
    place = F.pmod(F.col(ids.columns[0]), F.lit(BITS)) + 1
    found = ids.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).toArrow()
    out = np.zeros((BITS // _BUCKET, _BUCKET // 8), dtype=np.uint8)
    for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits")):
        out[bucket - 1] = np.frombuffer(bits.as_py(), np.uint8)
    return out.ravel()


def hits(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of some longs may be among the ids; those that are always hit."""
    place = np.mod(values, BITS)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
