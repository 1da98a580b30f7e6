"""Exact integer inner products: number types that hold them."""

from __future__ import annotations

import numpy as np
import pandas as pd

LARGEST = (1 << 63) - 1


def exact_kind(*matrices: np.ndarray) -> type:
    """The fastest type in which every inner product of rows of these BIGINT matrices is exact.

    The largest part squared times the number of dimensions bounds any partial sum: below 2**24 floats are exact, below
    2**53 doubles, below 2**63 BIGINTs, and beyond Python integers are taken.
    """
    most = max((max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in matrices), default=0)
    bound = most * most * max((m.shape[1] for m in matrices if m.ndim == 2), default=1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def matrix_of(column: pd.Series) -> np.ndarray:
    """A column of equally long BIGINT lists as a matrix."""
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def as_bigints(scores: np.ndarray) -> np.ndarray:
    """Exact scores as BIGINT; what lies beyond becomes its largest or smallest value."""
    if scores.dtype == object:
        return np.array([min(max(int(s), -LARGEST - 1), LARGEST) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


def norms(values: np.ndarray) -> np.ndarray:
    """Euclidean norms of rows, rounded up."""
    return np.sqrt(np.square(values.astype(np.float64)).sum(-1)) * (1 + 1e-9)
