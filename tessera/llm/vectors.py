"""Shared by the operators on vectors: which rows hold one, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers made from entries are held within this bound, far beyond what 64 bits of a sum or product allow.
MOST = 1 << 53


def usable(vector: Column) -> Column:
    """Not null, and all its entries are finite numbers."""
    entry = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.forall(vector, entry), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles; what a list lacks of ``width`` is 0."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def whole(values: np.ndarray, scale: int, most: int = MOST) -> np.ndarray:
    """floor(scale * value) as 64-bit integers, held within ``most``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * values), -most, most).astype(np.int64)


def exact(values: np.ndarray, times: int) -> np.ndarray:
    """``values`` as they are if ``times`` of them add up within 64 bits, else as Python's integers."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    return values if most * times < 1 << 62 else values.astype(object)
