"""Integer vectors from a column of float arrays, as the operators on embeddings read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers keep to this bound on either side, so that squared distances of a thousand components fit 64 bits.
BOUND = 1 << 25
#: Up to this bound, products of 64 components and their sums are exact in double precision.
EXACT = 1 << 22


def whole(vec: Column, size: Column | int) -> Column:
    """True for arrays of ``size`` components, none of them null, NaN or infinite; never null."""
    fine = F.forall(vec, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return F.coalesce((F.size(vec) == size) & fine, F.lit(False))


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """(rows, width): floor(scale * x) of each component x, as double works it out, kept within ``BOUND``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -BOUND, BOUND).astype(np.int64)


def squared(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(rows of x, rows of m): the exact squared distances of integer vectors."""
    if max(np.abs(x).max(initial=0), np.abs(m).max(initial=0)) <= EXACT and x.shape[1] <= 64:
        a, b = x.astype(np.float64), m.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in m], 1) if len(m) else np.zeros((len(x), 0), np.int64)
