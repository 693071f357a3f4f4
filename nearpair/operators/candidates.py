"""Candidate pairs: who shares a key, cut down by the bounds on sizes and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpair.functions.bounds import least_overlap, least_overlap_with_larger, pair_overlap
from nearpair.functions.tokens import deletion_keys
from nearpair.operators.signatures import rename_side


def inverted_index(keys: DataFrame) -> DataFrame:
    """`token, id` rows of prefix tokens. One row per entry: no list per token is built."""
    return keys.select("token", "id").distinct()


def set_candidates(
    left: DataFrame, right: DataFrame | None, measure: str, threshold: float
) -> DataFrame:
    """Distinct `id_l, id_r` of signature keys that may reach a set threshold.

    The smaller record of a pair only needs the shorter prefix implied by a partner at least
    as large as itself.
    """
    # the bounds name both sides, so neither is filtered before the shuffle: a self join
    # then reads one exchange of keys twice instead of computing the keys twice
    a, b = rename_side(left, "l"), rename_side(left if right is None else right, "r")
    on = (a["key"] == b["key"]) & set_bounds(measure, threshold)
    if right is None:
        on = on & (F.col("id_l") < F.col("id_r"))
    return distinct_ids(join_keys(a, b, on), ordered=right is None)


def join_keys(a: DataFrame, b: DataFrame, on: Column | str) -> DataFrame:
    """`a` with `b` by a shuffle of both, whatever their estimated sizes.

    Keys are generated, many per record, and the planner takes them for as small as the records:
    it would send the keys of a table of a few MB through the driver, a hundred times as large.
    """
    return a.join(b.hint("merge"), on)


def set_bounds(measure: str, threshold: float) -> Column:
    """What two key rows (columns suffixed _l, _r) of a matching pair satisfy, any side larger."""
    fits = size_fits(measure, threshold, F.col("n_l"), F.col("n_r"))
    return fits & _smaller_reaches(measure, threshold) & _rest_suffices(measure, threshold)


def size_fits(measure: str, threshold: float, n_left: Column, n_right: Column) -> Column:
    """Length filter: sizes (tokens, or q-grams for ed) that can belong to a matching pair."""
    if measure == "ed":
        return F.abs(n_left - n_right) <= int(threshold)
    larger, smaller = F.greatest(n_left, n_right), F.least(n_left, n_right)
    return smaller >= least_overlap(measure, threshold, larger)


def _smaller_reaches(measure: str, threshold: float) -> Column:
    def within(n: str, used: str, last: str) -> Column:
        size, count = F.col(n), F.col(used)
        shared = F.greatest(least_overlap_with_larger(measure, threshold, size), count)
        return F.col(last) <= size - shared + count

    return F.when(F.col("n_l") >= F.col("n_r"), within("n_r", "used_r", "last_r")).otherwise(
        within("n_l", "used_l", "last_l")
    )


def _rest_suffices(measure: str, threshold: float) -> Column:
    rest = F.least(F.col("n_l") - F.col("last_l"), F.col("n_r") - F.col("last_r"))
    return F.col("used_l") + rest >= pair_overlap(measure, threshold, F.col("n_l"), F.col("n_r"))


def ed_candidates(
    left: DataFrame, right: DataFrame | None, tau: int, q: int, positional: bool = False
) -> DataFrame:
    """Distinct `id_l, id_r` of signature keys with lengths (and positions) at most tau apart; keys
    with parity bits (plans.parts.gram_keys) are compared in these as well."""
    a, b = rename_side(left, "l"), rename_side(left if right is None else right, "r")
    on = (a["key"] == b["key"]) & ed_bounds(tau, q, positional)
    if "bits0" in left.columns:
        on = on & few_differing_bits(tau, q)
    if right is None:
        on = on & (F.col("id_l") < F.col("id_r"))
    return distinct_ids(join_keys(a, b, on), ordered=right is None)


def ed_bounds(tau: int, q: int, positional: bool = False) -> Column:
    """What two key rows (columns suffixed _l, _r) of a pair within tau edits satisfy.

    Pairs of texts too short for q-gram filters are left out: their keys prove nothing.
    """
    on = size_fits("ed", tau, F.col("n_l"), F.col("n_r"))
    on = on & (F.greatest("n_l", "n_r") > q * tau)
    if positional:
        second = position_fits(F.col("pos2_l"), F.col("pos2_r"), tau)
        on = on & position_fits(F.col("pos1_l"), F.col("pos1_r"), tau)
        on = on & F.coalesce(second, F.lit(True))
    return on


def position_fits(pos_left: Column, pos_right: Column, tau: int) -> Column:
    """Positional filter: a shared q-gram moved by at most tau places."""
    return F.abs(pos_left - pos_right) <= tau


def few_differing_bits(tau: int, q: int) -> Column:
    """Parity signatures (bits0, bits1, suffixed _l and _r) of texts within tau edits: they differ in
    no more bits than the texts have grams that are not shared."""
    return differing_bits() <= 2 * q * tau - F.abs(F.col("n_l") - F.col("n_r"))


def differing_bits() -> Column:
    """Bits in which the signatures of a pair differ: at most the grams that are not shared."""
    words = [F.bit_count(F.col(f"bits{k}_l").bitwiseXOR(F.col(f"bits{k}_r"))) for k in (0, 1)]
    return words[0] + words[1]


def neighbour_candidates(left: DataFrame, right: DataFrame | None, tau: int) -> DataFrame:
    """Distinct `id_l, id_r` of `id, text` rows that agree after at most tau deletions each.

    Finds every pair within edit distance tau without any statistics. The number of keys per
    text grows with length ** tau, but a key is shared only by texts at most 2 * tau edits
    apart, so no bucket grows with the table. Meant for names, addresses and short texts.
    """

    def keys(rows: DataFrame) -> DataFrame:
        # partitions are sized for the keys, hundreds per text: AQE would size them by the texts
        rows = rows.select("id", "text").repartition(shuffle_partitions(rows), "id")
        variants = F.explode_outer(deletion_keys(F.col("text"), tau)).alias("key")
        return rows.select("id", F.length("text").alias("n"), variants)

    a, b = rename_side(keys(left), "l"), rename_side(keys(left if right is None else right), "r")
    on = (a["key"] == b["key"]) & size_fits("ed", tau, F.col("n_l"), F.col("n_r"))
    if right is None:
        on = on & (F.col("id_l") < F.col("id_r"))
    return distinct_ids(join_keys(a, b, on), ordered=right is None)


def distinct_ids(pairs: DataFrame, ordered: bool, dealt: bool = False) -> DataFrame:
    """`id_l, id_r`, each pair once. `dealt` by id_l, for pairs that rarely come twice: they then meet
    its texts without another shuffle."""
    if ordered:
        pairs = pairs.select(
            F.least("id_l", "id_r").alias("id_l"), F.greatest("id_l", "id_r").alias("id_r")
        )
    # AQE sizes this, the largest table of a join
    pairs = pairs.select("id_l", "id_r")
    return (pairs.repartition("id_l") if dealt else pairs).distinct()


def shuffle_partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
