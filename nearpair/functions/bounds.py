"""What a threshold implies about sizes and overlaps: exact, never losing a pair.

`n` is the number of distinct tokens (set measures) or of padded q-grams (ed).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9  # float noise guard: bounds may only come out too weak, never too strong


def _ceil(value: Column) -> Column:
    return F.ceil(value - EPS).cast("int")


def least_overlap(measure: str, threshold: float, n: Column, q: int = 0) -> Column:
    """Tokens a record of size n shares with any partner. Also its smallest partner's size."""
    if measure == "ed":
        return (n - q * int(threshold)).cast("int")
    if measure == "jaccard":
        return _ceil(n * threshold)
    if measure == "cosine":
        return _ceil(n * (threshold * threshold))
    if measure == "dice":
        return _ceil(n * (threshold / (2 - threshold)))
    raise ValueError(f"unknown measure {measure!r}")


def least_overlap_with_larger(measure: str, threshold: float, n: Column) -> Column:
    """As least_overlap, for partners that are at least as large (set measures)."""
    if measure == "jaccard":
        return _ceil(n * (2 * threshold / (1 + threshold)))
    return _ceil(n * threshold)


def pair_overlap(measure: str, threshold: float, n1: Column, n2: Column, q: int = 0) -> Column:
    """Common tokens that a pair of these sizes needs."""
    if measure == "ed":
        return (F.greatest(n1, n2) - q * int(threshold)).cast("int")
    if measure == "jaccard":
        return _ceil((n1 + n2) * (threshold / (1 + threshold)))
    if measure == "cosine":
        return _ceil(F.sqrt(n1.cast("double") * n2) * threshold)
    if measure == "dice":
        return _ceil((n1 + n2) * (threshold / 2))
    raise ValueError(f"unknown measure {measure!r}")


def prefix_length(measure: str, threshold: float, n: Column, q: int = 0) -> Column:
    """How many of the first tokens in the global order form the prefix.

    For ed this is q * tau + 1, or all n grams of a shorter text.
    """
    shared = F.greatest(least_overlap(measure, threshold, n, q), F.lit(1))
    return F.greatest(n - shared + 1, F.lit(0)).cast("int")


def size_ratio(measure: str, threshold: float) -> float:
    """Least size of a set as a share of its partner's (set measures)."""
    if measure == "jaccard":
        return threshold
    return threshold * threshold if measure == "cosine" else threshold / (2 - threshold)


def symmetric_share(measure: str, threshold: float) -> float:
    """Most tokens in only one of two sets, as a share of twice the larger one (set measures).

    Jaccard and Dice bound them by a share of both sizes; for cosine, n1 + n2 - 2 * threshold *
    sqrt(n1 * n2) is largest at equal sizes within the sizes that a pair may have.
    """
    return (1 - threshold) / (1 + threshold) if measure == "jaccard" else 1 - threshold
