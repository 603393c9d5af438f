"""Vectors of whole numbers, shared by the search and the compression of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this count as this, so that squares and products of a vector's components add up exactly in 64 bits.
LARGEST = 1 << 27


def scaled(rows: DataFrame, vector: str = "embedding", scale: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v and the named columns of the rows whose vector is not null and holds no null or non-finite component; v has the
    components times scale, rounded down, as 32-bit numbers."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)))
    whole = lambda e: F.floor(F.least(F.greatest(e.cast("double") * scale, F.lit(-1.0 * LARGEST)), F.lit(1.0 * LARGEST))).cast("int")
    return rows.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), *keep, F.transform(x, whole).alias("v"))


def extent(rows: DataFrame) -> tuple[int, int]:
    """The number of vectors and the length of the longest one, 0 if there is none."""
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return n, d or 0


def matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as rows of d numbers of 64 bits; shorter ones end in zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out
