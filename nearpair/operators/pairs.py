"""Operations on pair tables (`id_l, id_r, ...`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_pairs(pairs: DataFrame) -> DataFrame:
    """Smaller id first, each pair once (`id_l, id_r`)."""
    return pairs.select(
        F.least("id_l", "id_r").alias("id_l"), F.greatest("id_l", "id_r").alias("id_r")
    ).distinct()


def sort_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("id_l", "id_r")


def subtract_pairs(pairs: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs whose ids do not occur in `other`."""
    return pairs.join(other.select("id_l", "id_r"), ["id_l", "id_r"], "left_anti")


def intersect_pairs(pairs: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs whose ids occur in `other`."""
    return pairs.join(other.select("id_l", "id_r"), ["id_l", "id_r"], "left_semi")


def evaluate_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row `predicted, truth, hits, precision, recall`; ratios are null over nothing.

    Both tables are counted in one pass over a grouping by pair.
    """
    marked = predicted.select("id_l", "id_r", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        truth.select("id_l", "id_r", F.lit(0).alias("p"), F.lit(1).alias("t"))
    )
    once = marked.groupBy("id_l", "id_r").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    counts = once.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("truth"),
        F.coalesce(F.sum(F.col("p") * F.col("t")), F.lit(0)).alias("hits"),
    )
    return counts.select(
        "predicted",
        "truth",
        "hits",
        F.try_divide(F.col("hits").cast("double"), F.col("predicted").cast("double")).alias("precision"),
        F.try_divide(F.col("hits").cast("double"), F.col("truth").cast("double")).alias("recall"),
    )


def weigh_pairs(scored: DataFrame, groups: DataFrame | None, same_score) -> DataFrame:
    """The group pair table `id_l, id_r, score, pairs` from scored group pairs.

    `pairs` counts the record pairs a row stands for. With `groups` (self join), each group of
    at least two equal records adds a row with id_l = id_r for the pairs inside it.
    """
    result = scored.select(
        "id_l", "id_r", "score", (F.col("records_l") * F.col("records_r")).alias("pairs")
    )
    if groups is None:
        return result
    inside = groups.filter(F.col("records") > 1).select(
        F.col("id").alias("id_l"),
        F.col("id").alias("id_r"),
        same_score.alias("score"),
        F.expr("records * (records - 1) div 2").alias("pairs"),
    )
    return result.unionByName(inside)


def both_ways(weighed: DataFrame, groups: DataFrame, same_score) -> DataFrame:
    """The group pair table of a table joined with itself as a second one, from its pairs with
    id_l < id_r: each pair both ways, and each group with itself."""
    turned = F.struct(F.col("id_r").alias("id_l"), F.col("id_l").alias("id_r"))
    ways = F.inline(F.array(F.struct("id_l", "id_r"), turned))
    itself = groups.select(
        F.col("id").alias("id_l"),
        F.col("id").alias("id_r"),
        same_score.alias("score"),
        (F.col("records") * F.col("records")).alias("pairs"),
    )
    return weighed.select(ways, "score", "pairs").unionByName(itself)


def expand_pairs(
    group_pairs: DataFrame, members_left: DataFrame, members_right: DataFrame | None = None
) -> DataFrame:
    """Record pairs `id_l, id_r, score` of a group pair table.

    `members_*` map records to groups (`id, group_id`). The result has as many rows as
    sum(pairs), which is quadratic in the size of a group of copies: it is for callers who
    need every record pair, and the joins never need it themselves. Large groups skew the
    member joins on the members' side only, where AQE splits them.
    """
    self_join = members_right is None
    right = members_left if self_join else members_right
    a = members_left.select(F.col("id").alias("_a"), F.col("group_id").alias("id_l"))
    b = right.select(F.col("id").alias("_b"), F.col("group_id").alias("id_r"))
    rows = group_pairs.select("id_l", "id_r", "score").join(a, "id_l").join(b, "id_r")
    if not self_join:
        return rows.select(F.col("_a").alias("id_l"), F.col("_b").alias("id_r"), "score")
    rows = rows.filter((F.col("id_l") != F.col("id_r")) | (F.col("_a") < F.col("_b")))
    return rows.select(
        F.least("_a", "_b").alias("id_l"), F.greatest("_a", "_b").alias("id_r"), "score"
    )


def attach_texts(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Add text_l and text_r to a pair table."""
    a = left.select(F.col("id").alias("id_l"), F.col("text").alias("text_l"))
    b = (left if right is None else right).select(
        F.col("id").alias("id_r"), F.col("text").alias("text_r")
    )
    joined = pairs.join(a, "id_l").join(b, "id_r")
    rest = [c for c in pairs.columns if c not in ("id_l", "id_r")]
    return joined.select("id_l", "text_l", "id_r", "text_r", *rest)
