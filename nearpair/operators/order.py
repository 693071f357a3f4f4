"""Global token order, prefixes and the edit-error bound on sets of q-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERINGS = ("idf", "alphabetical")

# The most frequent tokens, whose counts go to every task. Of the other tokens none then holds
# more than 1 / FREQUENT of all occurrences. With at most FREQUENT_BYTES each they are 1 MB.
FREQUENT = 4_096
FREQUENT_BYTES = 256
FREQUENT_HASHES = 65_536  # tokens as hashes: 1 MB as well

BIT_WORDS = 1 << 16  # of 64 bits, 1 MB in all (a broadcast), that say which values may occur

_CODE_HASH_BITS = (1 << 32) - 1
_CODE_MAX_FREQ = (1 << 31) - 1


def token_frequency(*bags: DataFrame) -> DataFrame:
    """`token, freq`: occurrences (repeats count) over one or more tables with `tokens` arrays."""
    streams = [token_rows(bag).select("token") for bag in bags]
    return (
        reduce(DataFrame.unionByName, streams)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def token_rows(bags: DataFrame) -> DataFrame:
    """`id, token, pos`: one row per token of `id, tokens`, position from 0."""
    # the outer form keeps Spark from testing the array's size first, which would build it twice
    rows = bags.select("id", F.posexplode_outer("tokens").alias("pos", "token"))
    return rows.filter(F.col("token").isNotNull())


def with_frequency(rows: DataFrame, freq: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """`rows` with the `freq` of their `token`; rows whose token `freq` lacks (or null) go.

    The `frequent` tokens of highest count are joined by a broadcast of at most that many rows,
    the others by a shuffle. So a token that holds a third of all occurrences is never a key of
    the shuffle, and most occurrences of natural text are not shuffled at all. The top is exact:
    the counts are there, so no sketch has to guess it.
    """
    # tied to `freq` so that the counts are filtered, not (counting again) the tokens
    size = F.when(F.col("freq") > 0, F.octet_length("token"))
    top = freq.filter(size <= FREQUENT_BYTES).orderBy(F.desc("freq"), "token").limit(frequent)
    hot = rows.join(F.broadcast(top), "token")
    rest = rows.join(F.broadcast(top.select("token")), "token", "left_anti").join(freq, "token")
    return hot.unionByName(rest)


def order_tokens(bags: DataFrame, ordering: str = "idf", freq: DataFrame | None = None) -> DataFrame:
    """`id, token, pos, rank`: a record's tokens ranked from 1 in the global order.

    idf: rarest token first, ties by the token itself, then by position.
    alphabetical: by the token, then by position.
    """
    check_ordering(ordering)
    rows = token_rows(bags)
    if ordering == "idf":
        rows = with_frequency(rows, token_frequency(bags) if freq is None else freq)
        by = ["freq", "token", "pos"]
    else:
        by = ["token", "pos"]
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*by))
    return rows.select("id", "token", "pos", rank.alias("rank"))


def ordered_arrays(bags: DataFrame, ordering: str = "idf", freq: DataFrame | None = None) -> DataFrame:
    """`id, ordered`: the same order as one array of (freq, token, pos) per record."""
    check_ordering(ordering)
    freq = token_frequency(bags) if freq is None else freq
    rows = token_rows(bags).join(freq, "token")
    entry = F.struct("freq", "token", "pos")
    arrays = rows.groupBy("id").agg(F.collect_list(entry).alias("_all"))
    by_order = F.sort_array("_all")
    if ordering == "alphabetical":
        keyed = F.transform("_all", lambda e: F.struct(e["token"], e["pos"], e["freq"]))
        by_order = F.transform(
            F.sort_array(keyed),
            lambda e: F.struct(
                e["freq"].alias("freq"), e["token"].alias("token"), e["pos"].alias("pos")
            ),
        )
    return arrays.select("id", by_order.alias("ordered"))


def ordered_codes(bags: DataFrame, freq: DataFrame) -> DataFrame:
    """`id, codes`: rarest-first order of token sets as one sorted array of numbers.

    A code holds the frequency above 32 bits of the token's hash. Sorting numbers is far
    cheaper than sorting (freq, token) pairs. Two tokens with equal codes count as one token,
    which can only add candidates. Numbers as tokens are taken for hashes.
    """
    hashes = dict(bags.dtypes)["tokens"] == "array<bigint>"
    rows = bags.select("id", F.explode_outer("tokens").alias("token"))
    rows = with_frequency(rows, freq, FREQUENT_HASHES if hashes else FREQUENT)
    code = _code(F.col("token") if hashes else F.xxhash64("token"))
    codes = rows.groupBy("id").agg(F.collect_list(code).alias("codes"))
    return codes.select("id", F.sort_array("codes").alias("codes"))


def _code(hashed: Column) -> Column:
    capped = F.least(F.col("freq"), F.lit(_CODE_MAX_FREQ))
    return F.shiftleft(capped, 32) + hashed.bitwiseAND(F.lit(_CODE_HASH_BITS))


def shared_orders(left: DataFrame, right: DataFrame, ordering: str = "idf") -> list[DataFrame]:
    """`id, n, ordered` of two tables' `id, tokens` sets (tokens as hashes; for alphabetical they come in
    the order of their tokens), ordered by their joint frequency: (freq, token, pos) entries, pos null.

    Of the left table's tokens only those are counted and shuffled that the right one may hold. The
    others match nothing: they have frequency 0 and, with idf, come first.
    """
    check_ordering(ordering)
    rows = [b.select("id", F.size("tokens").alias("n"), F.posexplode_outer("tokens").alias("pos", "token")) for b in (left, right)]
    rows[0] = with_bits(rows[0], rows[1].select("token"), "token")
    freq = rows[0].select("token").unionByName(rows[1].select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    return [_shared_order(with_frequency(r, freq, FREQUENT_HASHES), ordering) for r in rows]


def _shared_order(rows: DataFrame, ordering: str) -> DataFrame:
    def entry(freq: Column, token: Column) -> Column:
        return F.struct(freq.alias("freq"), token.alias("token"), F.lit(None).cast("int").alias("pos"))

    none = entry(F.lit(0).cast("bigint"), F.lit(None).cast("bigint"))
    size = F.greatest(F.max("n"), F.count(F.lit(1)).cast("int")).alias("n")
    if ordering == "idf":
        sets = rows.groupBy("id").agg(size, F.collect_list(_code(F.col("token"))).alias("_all"))
        known = F.transform(F.sort_array("_all"), lambda c: entry(code_freq(c), c))
        return sets.select("id", "n", F.concat(F.array_repeat(none, F.col("n") - F.size("_all")), known).alias("ordered"))
    sets = rows.groupBy("id").agg(size, F.sort_array(F.collect_list(F.struct("pos", "freq", "token"))).alias("_all"))

    def filled(e: Column, i: Column) -> Column:
        gap = e["pos"] - F.when(i == 0, -1).otherwise(F.get("_all", i - 1)["pos"]) - 1
        return F.concat(F.array_repeat(none, gap), F.array(entry(e["freq"], e["token"])))

    rest = F.array_repeat(none, F.col("n") - 1 - F.element_at("_all", -1)["pos"])
    return sets.select("id", "n", F.concat(F.flatten(F.transform("_all", filled)), rest).alias("ordered"))


def with_bits(frame: DataFrame, known: DataFrame, column: str = "id", words: int = BIT_WORDS) -> DataFrame:
    """Rows of `frame` whose `column` is among the values of `known` (one column), and some others: the
    hash of a value says its word and bit, and all words are a broadcast."""

    def place(value: Column) -> tuple[Column, Column]:
        hashed = F.xxhash64(value, F.lit(3))
        return F.pmod(hashed, F.lit(words)).cast("int"), F.shiftrightunsigned(hashed, 58).cast("int")

    def bit(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)

    word, at = place(F.col(column))
    named = known.groupBy(word.alias("_word")).agg(F.bit_or(bit(at)).alias("_bits"))
    rows = frame.withColumn("_word", word).join(F.broadcast(named), "_word")
    return rows.filter(F.col("_bits").bitwiseAND(bit(at)) != 0).select(*frame.columns)


def code_freq(code: Column) -> Column:
    return F.shiftright(code, 32)


def min_edit_errors(positions: Column, q: int) -> Column:
    """Fewest edits that can destroy all q-grams at these positions (an int array).

    Greedy from the left: an edit at the end of the first remaining gram destroys every gram
    that starts less than q characters after it.
    """
    start = F.struct(F.lit(0).alias("errors"), F.lit(-1).alias("reach"))

    def step(state: Column, pos: Column) -> Column:
        free = pos > state["reach"]
        return F.struct(
            F.when(free, state["errors"] + 1).otherwise(state["errors"]).alias("errors"),
            F.when(free, pos + (q - 1)).otherwise(state["reach"]).alias("reach"),
        )

    return F.aggregate(F.array_sort(positions), start, step, lambda state: state["errors"])


def min_prefix_length(positions: Column, tau: int, q: int) -> Column:
    """Shortest prefix whose grams need more than tau edits; all grams if none does.

    `positions` are gram positions in the global order. A prefix of q * tau + 1 grams always
    needs more than tau edits, so no longer one is tried.
    """
    size = F.size(positions)
    longest = F.least(size, F.lit(q * tau + 1))

    def enough(k: Column) -> Column:
        return min_edit_errors(F.slice(positions, 1, k), q) > tau

    tried = F.filter(F.sequence(F.least(F.lit(tau + 1), longest), longest), enough)
    return F.when(size == 0, F.lit(0)).otherwise(F.coalesce(F.get(tried, F.lit(0)), size))


def check_ordering(ordering: str) -> None:
    if ordering not in ORDERINGS:
        raise ValueError(f"ordering must be one of {ORDERINGS}, got {ordering!r}")
