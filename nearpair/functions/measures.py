"""Measures on a pair of columns. Similarities are null where a side has no tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SET_MEASURES = ("jaccard", "cosine", "dice")
MEASURES = ("ed", *SET_MEASURES)


def edit_distance(left: Column, right: Column, limit: int | None = None) -> Column:
    """Edit distance in characters; with `limit`, -1 where it exceeds the limit."""
    return F.levenshtein(left, right, limit)


def overlap(left: Column, right: Column) -> Column:
    """Number of common distinct tokens."""
    return F.size(F.array_intersect(left, right))


def similarity_from_counts(measure: str, common: Column, n_left: Column, n_right: Column) -> Column:
    """Set similarity from the sizes of two token sets and of their intersection."""
    if measure == "jaccard":
        return F.try_divide(common.cast("double"), (n_left + n_right - common).cast("double"))
    if measure == "cosine":
        return F.try_divide(common.cast("double"), F.sqrt(n_left.cast("double") * n_right))
    if measure == "dice":
        return F.try_divide(2.0 * common, (n_left + n_right).cast("double"))
    raise ValueError(f"measure must be one of {SET_MEASURES}, got {measure!r}")


def set_similarity(measure: str, left: Column, right: Column) -> Column:
    """Similarity of two token arrays, read as sets."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    score = similarity_from_counts(measure, overlap(a, b), F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), score)


def jaccard(left: Column, right: Column) -> Column:
    return set_similarity("jaccard", left, right)


def cosine(left: Column, right: Column) -> Column:
    return set_similarity("cosine", left, right)


def dice(left: Column, right: Column) -> Column:
    return set_similarity("dice", left, right)


def check_measure(measure: str, allowed: tuple[str, ...] = MEASURES) -> None:
    if measure not in allowed:
        raise ValueError(f"measure must be one of {allowed}, got {measure!r}")


def check_threshold(measure: str, threshold: float) -> None:
    if measure == "ed":
        if isinstance(threshold, bool) or int(threshold) != threshold or threshold < 0:
            raise ValueError(f"an edit distance threshold is an integer >= 0, got {threshold!r}")
    elif not 0 < threshold <= 1:
        raise ValueError(f"a similarity threshold lies in (0, 1], got {threshold!r}")
