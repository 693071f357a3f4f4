"""Steps shared by the join plans: from groups to signature keys, from candidates to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpair.functions.bounds import least_overlap, prefix_length, size_ratio
from nearpair.functions.measures import edit_distance, similarity_from_counts
from nearpair.functions.tokens import qgram_count, qgrams
from nearpair.operators.blocks import common_tokens
from nearpair.operators.candidates import join_keys, neighbour_candidates
from nearpair.operators.order import (
    code_freq,
    min_prefix_length,
    ordered_arrays,
    ordered_codes,
    shared_orders,
    token_frequency,
    with_bits,
)
from nearpair.operators.signatures import HOT_GRAM, HOT_TOKEN, signature_keys


def set_keys(
    groups: list[DataFrame],
    measure: str,
    threshold: float,
    ordering: str = "idf",
    hot_token: int = HOT_TOKEN,
) -> list[DataFrame]:
    """Signature keys per side; both sides are ordered by their joint token frequency. Of two tables,
    the left one (the larger, if any) has those keys only that the right one may have too."""
    bags = [g.select("id", "tokens") for g in groups]
    n = F.col("n")
    prefix = prefix_length(measure, threshold, n)
    two = len(groups) == 2 and groups[0] is not groups[1]
    tokens = F.sort_array("tokens") if ordering == "alphabetical" else F.col("tokens")
    # of tokens only the order counts here: their hashes are shuffled
    hashed = [b.select("id", F.transform(tokens, lambda t: F.xxhash64(t)).alias("tokens")) for b in bags]
    if two:
        reached = F.slice("ordered", F.lit(1), prefix + 1)
        sized = [a.select("id", "n", reached.alias("ordered")) for a in shared_orders(*hashed, ordering)]
    elif ordering == "idf":
        bags = hashed
        freq = token_frequency(*bags)
        sized = [_from_codes(ordered_codes(bag, freq), prefix) for bag in bags]
    else:
        sized = [a.withColumn("n", F.size("ordered")) for a in _ordered(bags, ordering)]
    least, ratio = least_overlap(measure, threshold, n), size_ratio(measure, threshold)
    keys = [signature_keys(s, prefix, least, hot_token, ratio=ratio) for s in sized]
    return [with_bits(keys[0], keys[1].select("key"), "key"), keys[1]] if two else keys


def _from_codes(codes: DataFrame, prefix: Column) -> DataFrame:
    first = F.slice("codes", F.lit(1), prefix + 1)
    entries = F.transform(
        first,
        lambda c: F.struct(
            code_freq(c).alias("freq"), c.alias("token"), F.lit(None).cast("int").alias("pos")
        ),
    )
    sized = codes.withColumn("n", F.size("codes"))
    return sized.select("id", "n", entries.alias("ordered"))


def gram_keys(
    texts: list[DataFrame],
    tau: int,
    q: int,
    ordering: str = "idf",
    hot_token: int = HOT_GRAM,
    minimum: bool = False,
    parity: bool = False,
) -> list[DataFrame]:
    """Signature keys of the q-grams per side; `minimum` takes the location-based prefix, `parity`
    adds the parity bits of all of a text's grams (bits0, bits1)."""
    bags = [t.select("id", qgrams(F.col("text"), q).alias("tokens")) for t in texts]
    n = F.col("n")
    keys = []
    for arrays in _ordered(bags, ordering):
        prefix = (
            min_prefix_length(F.col("first_pos"), tau, q)
            if minimum
            else prefix_length("ed", tau, n, q)
        )
        sized = arrays.withColumn("n", F.size("ordered")).withColumn(
            "first_pos", F.transform(F.slice("ordered", 1, q * tau + 1), lambda e: e["pos"])
        )
        if parity:
            sized = sized.withColumns({f"bits{k}": _parity(k) for k in (0, 1)})
        keep = ("bits0", "bits1") if parity else ()
        keys.append(signature_keys(sized, prefix, least_overlap("ed", tau, n, q), hot_token, keep))
    return keys


def _parity(word: int) -> Column:
    """Of 128 places, dealt by the hash, the 64 of this word: is the number of grams there odd."""

    def step(bits: Column, e: Column) -> Column:
        place = F.pmod(F.xxhash64(e["token"]), F.lit(128)).cast("int") - 64 * word
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        return F.when((place >= 0) & (place < 64), bits.bitwiseXOR(bit)).otherwise(bits)

    return F.aggregate("ordered", F.lit(0).cast("bigint"), step)


def _ordered(bags: list[DataFrame], ordering: str) -> list[DataFrame]:
    freq = token_frequency(*bags)
    return [ordered_arrays(bag, ordering, freq) for bag in bags]


def with_short_pairs(
    candidates: DataFrame, left: DataFrame, right: DataFrame | None, tau: int, q: int
) -> DataFrame:
    """Add the candidates that no q-gram filter can see: both texts have at most q * tau grams."""
    if tau == 0:
        return candidates

    def short(texts: DataFrame) -> DataFrame:
        return texts.filter(qgram_count(F.col("text"), q) <= q * tau).select("id", "text")

    found = neighbour_candidates(short(left), None if right is None else short(right), tau)
    return candidates.unionByName(found)  # ed_bounds leaves these pairs out: no overlap


def sides(candidates: DataFrame, left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Candidates with both groups' columns, suffixed _l and _r."""
    a = left.select(*[F.col(c).alias(f"{c}_l") for c in left.columns])
    other = left if right is None else right
    b = other.select(*[F.col(c).alias(f"{c}_r") for c in other.columns])
    # by shuffles: beside a table of a few MB the planner would send all its texts through the driver
    return join_keys(join_keys(candidates, a, "id_l"), b, "id_r")


def verify_ed(pairs: DataFrame, tau: int) -> DataFrame:
    """Keep pairs (text_l, text_r) within tau edits; adds the distance as `score`."""
    score = edit_distance(F.col("text_l"), F.col("text_r"), tau)
    return pairs.filter(score >= 0).withColumn("score", score)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """`rows` with a column that is evaluated once a row, however often it is used.

    A generator stands between: the optimizer would copy a plain expression into every use.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def verify_sets(
    candidates: DataFrame, left: DataFrame, right: DataFrame | None, measure: str, threshold: float, passes: Column | None = None
) -> DataFrame:
    """Candidates `id_l, id_r` whose token sets reach the threshold, with their sizes n, records (_l and
    _r) and `common` tokens; adds the `score`. `passes` takes the place of the threshold, if tighter."""
    counted = common_tokens(candidates, left, right, measure, threshold)
    score = similarity_from_counts(measure, F.col("common"), F.col("n_l"), F.col("n_r"))
    return counted.withColumn("score", score).filter(F.col("score") >= threshold if passes is None else passes)


def same_text() -> Column:
    return F.lit(0)


def same_tokens() -> Column:
    return F.lit(1.0)
