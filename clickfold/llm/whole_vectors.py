"""Vectors in whole numbers, and exact products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256
#: Components of a scaled vector stay below this, so that squared distances and products of
#: vectors of a few hundred dimensions fit in a long.
LIMIT = 1 << 27


def is_whole(vector: Column) -> Column:
    """True for a vector without null or non-finite components; false for a null vector."""
    bad = F.exists(
        vector.cast("array<double>"),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(vector: Column) -> Column:
    """floor(256 * x) of every component as array<int>; larger ones than LIMIT raise."""
    return F.transform(
        vector.cast("array<double>"),
        lambda x: F.when(F.abs(x) < LIMIT // SCALE, F.floor(x * SCALE).cast("int")).otherwise(
            F.raise_error(F.lit(f"a component is not below {LIMIT // SCALE}")).cast("int")
        ),
    )


def matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of an array<int> column, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    rows = np.zeros((len(lengths), width), np.int32)
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows


def largest(x: np.ndarray) -> int:
    return int(np.abs(x.astype(np.int64)).max(initial=0))


def exact_type(bound: int) -> type:
    """The quickest number type in which sums up to ``bound`` are exact."""
    for limit, kind in ((1 << 24, np.float32), (1 << 53, np.float64), (1 << 63, np.int64)):
        if bound < limit:
            return kind
    raise ValueError("the products of these vectors do not fit in a long")
