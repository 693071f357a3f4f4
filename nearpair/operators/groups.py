"""Equal records, kept once.

Records that a measure cannot tell apart (equal texts for ed, equal token sets for the set
measures) form one group, named after its lowest id. Joins compare groups, so a group of
copies costs one comparison however many records it holds; `records` says how many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpair.functions.tokens import tokenize


def text_groups(records: DataFrame) -> DataFrame:
    """`id, text, records`: one row per distinct text."""
    return _grouped(records.filter(F.col("text").isNotNull()), F.col("text"), "text")


def token_groups(records: DataFrame, tokenizer: str = "space", q: int = 3) -> DataFrame:
    """`id, tokens, records`: one row per distinct non-empty token set (tokens sorted)."""
    sets = _token_sets(records, tokenizer, q)
    if tokenizer == "space":
        # no token holds a space: sets are shuffled as texts, two thirds as large as arrays
        texts = _grouped(sets, F.array_join("tokens", " "), "_set")
        tokens = F.when(F.col("records") > 0, F.split("_set", " "))
        return texts.filter(F.octet_length("_set") > 0).select("id", tokens.alias("tokens"), "records")
    # tied to `records` so that the test runs on groups, not (tokenizing again) on records
    size = F.when(F.col("records") > 0, F.size("tokens"))
    return _grouped(sets, F.col("tokens"), "tokens").filter(size > 0)


def text_members(records: DataFrame) -> DataFrame:
    """`id, group_id` for every record that can take part in an ed join."""
    rows = records.filter(F.col("text").isNotNull()).select("id", "text")
    return _members(rows, text_groups(records), "text")


def token_members(records: DataFrame, tokenizer: str = "space", q: int = 3) -> DataFrame:
    """`id, group_id` for every record that can take part in a set join."""
    rows = _token_sets(records, tokenizer, q)
    return _members(rows, token_groups(records, tokenizer, q), "tokens")


def _token_sets(records: DataFrame, tokenizer: str, q: int) -> DataFrame:
    tokens = F.sort_array(F.array_distinct(tokenize(F.col("text"), tokenizer, q)))
    return records.filter(F.col("text").isNotNull()).select("id", tokens.alias("tokens"))


def _grouped(rows: DataFrame, by: Column, name: str) -> DataFrame:
    groups = rows.groupBy(by.alias(name)).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("records")
    )
    # always true; keeps both aggregates in every use, so that all uses share one exchange
    groups = groups.filter(F.col("id").isNotNull() & (F.col("records") > 0))
    return groups.select("id", name, "records")


def _members(rows: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    # a large group of copies skews this join on one side only, which AQE splits
    names = groups.select(F.col("id").alias("group_id"), name)
    return rows.join(names, name).select("id", "group_id")
