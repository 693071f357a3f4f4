"""One query per operator. Each takes (spark, folder of parquet tables) and returns a DataFrame.

All run over whole tables. Joins return group pairs (see nearpair.operators.groups): their
size follows the number of distinct texts, not the number of copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpair.api import similarity_join
from nearpair.functions import bounds, measures
from nearpair.functions.tokens import char_tokens, qgram_count, qgrams, space_tokens
from nearpair.operators import filters
from nearpair.operators.candidates import ed_candidates, inverted_index
from nearpair.operators.cells import cell_sizes, choose_anchors, route
from nearpair.operators.groups import text_groups, text_members, token_groups, token_members
from nearpair.operators.order import (
    min_edit_errors,
    min_prefix_length,
    order_tokens,
    ordered_arrays,
    token_frequency,
    token_rows,
)
from nearpair.operators.occurrences import shared_gram_counts
from nearpair.operators.pairs import (
    evaluate_pairs,
    intersect_pairs,
    normalize_pairs,
    sort_pairs,
    subtract_pairs,
)
from nearpair.operators.reports import bucket_sizes, method_counts, stage_counts
from nearpair.plans import joins
from nearpair.plans.parts import gram_keys, sides
from nearpair.sources import (
    read_csv_records,
    records_from_columns,
    shared_folder,
    with_row_ids,
    write_pairs,
)

Query = Callable[[SparkSession, str], DataFrame]

Q = 3  # q-gram size of all queries
TAU = 1  # edit distance of the join queries on part
FILTER_TAU = 2  # edit distance of the filter queries and of the queries on urls
SIMILARITY = 0.8
RS_SIMILARITY = 0.3  # documents against benchmark items, which are parts of documents
ANCHORS = 16
CELL_ANCHORS = 8

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- tables as records ---------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Names that share a long prefix: every q-gram of theirs is frequent."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("text")
    )


def urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("text")
    )


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation turn with the next one."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_r")
    )
    return turns.withColumnRenamed("text", "text_l").join(following, ["conv_id", "turn"])


def rounded(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.round("score", 6))


# -- sources and sinks ---------------------------------------------------------------------

RECORD_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]


@query
def records_from_columns_(spark, folder):
    return records_from_columns(table(spark, folder, "part"), "p_partkey", RECORD_COLUMNS)


@query
def records_row_ids(spark, folder):
    return with_row_ids(table(spark, folder, "part").select("p_partkey", "p_name"))


@query
def records_csv(spark, folder):
    path = shared_folder(spark, "records")
    table(spark, folder, "part").select("p_partkey", *RECORD_COLUMNS).write.csv(path)
    return read_csv_records(spark, path, id_col="_c0")


@query
def write_pairs_(spark, folder):
    path = shared_folder(spark, "pairs")
    write_pairs(joins.prefix_ed(text_groups(parts(spark, folder)), None, TAU, Q), path)
    return spark.read.parquet(path)


@query
def record_groups_text(spark, folder):
    return text_members(parts(spark, folder))


@query
def record_groups_tokens(spark, folder):
    return token_members(documents(spark, folder))


# -- tokens --------------------------------------------------------------------------------


def space_bags(spark, folder):
    return documents(spark, folder).select("id", space_tokens(F.col("text")).alias("tokens"))


def gram_bags(spark, folder):
    return parts(spark, folder).select("id", qgrams(F.col("text"), Q).alias("tokens"))


@query
def tokens_space(spark, folder):
    return token_rows(space_bags(spark, folder)).select("id", "token")


@query
def tokens_qgram(spark, folder):
    return token_rows(gram_bags(spark, folder)).select("id", "token")


@query
def tokens_qgram_pos(spark, folder):
    return token_rows(gram_bags(spark, folder))


@query
def tokens_char(spark, folder):
    chars = documents(spark, folder).select("id", char_tokens(F.col("text")).alias("tokens"))
    return token_rows(chars).select("id", "token")


# -- global order and prefixes -------------------------------------------------------------


@query
def token_frequency_(spark, folder):
    return token_frequency(space_bags(spark, folder))


@query
def token_frequency_joint(spark, folder):
    turns = table(spark, folder, "conversations").select(space_tokens(F.col("text")).alias("tokens"))
    return token_frequency(space_bags(spark, folder), turns.withColumn("id", F.lit(0)))


@query
def token_order_idf(spark, folder):
    return order_tokens(space_bags(spark, folder)).select("id", "rank", "token")


@query
def token_order_alpha(spark, folder):
    ordered = order_tokens(space_bags(spark, folder), "alphabetical")
    return ordered.select("id", "rank", "token")


@query
def gram_order_idf(spark, folder):
    return order_tokens(gram_bags(spark, folder)).select("id", "rank", "token", "pos")


@query
def prefix_length_(spark, folder):
    sizes = documents(spark, folder).select(
        "id",
        F.size(F.array_distinct(space_tokens(F.col("text")))).alias("tokens"),
        qgram_count(F.col("text"), Q).alias("grams"),
    )
    lengths = [
        bounds.prefix_length(m, SIMILARITY, F.col("tokens")).alias(m) for m in measures.SET_MEASURES
    ]
    return sizes.select(
        "id", "tokens", "grams", *lengths, bounds.prefix_length("ed", TAU, F.col("grams"), Q).alias("ed")
    )


def ranked_prefixes(spark, folder):
    """Prefix tokens (Jaccard) of the distinct token sets: `id, token, rank`."""
    ordered = order_tokens(token_groups(documents(spark, folder)).select("id", "tokens"))
    sets = token_groups(documents(spark, folder)).select("id", F.size("tokens").alias("n"))
    length = bounds.prefix_length("jaccard", SIMILARITY, F.col("n"))
    return ordered.join(sets, "id").filter(F.col("rank") <= length).select("id", "token", "rank")


@query
def prefix_tokens(spark, folder):
    return ranked_prefixes(spark, folder)


def gram_positions(spark, folder):
    """Positions of the q-grams in the global order, per distinct text."""
    texts = text_groups(parts(spark, folder))
    bags = texts.select("id", qgrams(F.col("text"), Q).alias("tokens"))
    places = F.transform("ordered", lambda e: e["pos"])
    return ordered_arrays(bags).select("id", places.alias("positions"))


@query
def min_edit_errors_(spark, folder):
    return gram_positions(spark, folder).select(
        "id", min_edit_errors(F.col("positions"), Q).alias("errors")
    )


@query
def min_prefix_length_(spark, folder):
    return gram_positions(spark, folder).select(
        "id", min_prefix_length(F.col("positions"), FILTER_TAU, Q).alias("length")
    )


# -- candidates and filters ----------------------------------------------------------------


@query
def inverted_index_(spark, folder):
    return inverted_index(ranked_prefixes(spark, folder))


@query
def bucket_sizes_(spark, folder):
    return bucket_sizes(inverted_index(ranked_prefixes(spark, folder)))


@query
def candidates_self(spark, folder):
    groups = token_groups(documents(spark, folder))
    return joins.prefix_set_candidates(groups, None, "jaccard", SIMILARITY)


@query
def candidates_rs(spark, folder):
    left = token_groups(documents(spark, folder))
    right = token_groups(benchmark(spark, folder))
    # ranks among equally rare tokens differ from engine to engine; those by name do not
    return joins.prefix_set_candidates(left, right, "jaccard", RS_SIMILARITY, "alphabetical")


@query
def filter_length(spark, folder):
    return joins.prefix_ed_candidates(text_groups(parts(spark, folder)), None, FILTER_TAU, Q)


@query
def filter_position(spark, folder):
    (keys,) = gram_keys([text_groups(parts(spark, folder))], TAU, Q)
    return ed_candidates(keys, None, TAU, Q, positional=True)


def profiled_candidates(spark, folder):
    texts = text_groups(parts(spark, folder))
    candidates = joins.prefix_ed_candidates(texts, None, FILTER_TAU, Q)
    return sides(candidates, filters.gram_profiles(texts, Q, FILTER_TAU), None)


@query
def filter_count(spark, folder):
    enough = filters.enough_common_grams(
        F.col("grams_l"), F.col("grams_r"), F.col("n_l"), F.col("n_r"), Q, FILTER_TAU
    )
    return profiled_candidates(spark, folder).filter(enough).select("id_l", "id_r")


def mismatches(spark, folder):
    missing = filters.mismatched_positions(F.col("placed_l"), F.col("nearby_r"), Q)
    rows = profiled_candidates(spark, folder).withColumn("missing", missing)
    return rows.filter(filters.few_mismatches(F.col("missing"), Q, FILTER_TAU))


@query
def filter_mismatch_count(spark, folder):
    return mismatches(spark, folder).select("id_l", "id_r", F.size("missing").alias("mismatches"))


@query
def filter_mismatch_location(spark, folder):
    rows = mismatches(spark, folder)
    explained = filters.mismatches_explained(F.col("missing"), Q, FILTER_TAU)
    return rows.filter(explained).select("id_l", "id_r")


@query
def filter_content(spark, folder):
    similar = filters.similar_content(F.col("chars_l"), F.col("chars_r"), FILTER_TAU)
    return profiled_candidates(spark, folder).filter(similar).select("id_l", "id_r")


@query
def filter_content_windows(spark, folder):
    rows = mismatches(spark, folder)
    similar = filters.similar_windows(F.col("missing"), F.col("text_l"), F.col("text_r"), Q, FILTER_TAU)
    return rows.filter(similar).select("id_l", "id_r")


@query
def gram_counts(spark, folder):
    return shared_gram_counts(text_groups(parts(spark, folder)), TAU, Q)


# -- measures ------------------------------------------------------------------------------


@query
def score_edit_distance(spark, folder):
    pages = urls(spark, folder)
    following = pages.select((F.col("id") - 1).alias("id"), F.col("text").alias("text_r"))
    score = measures.edit_distance(F.col("text"), F.col("text_r"))
    return pages.join(following, "id").select("id", score.alias("score"))


def turn_scores(spark, folder, measure):
    left, right = space_tokens(F.col("text_l")), space_tokens(F.col("text_r"))
    score = measures.set_similarity(measure, left, right)
    return rounded(turn_pairs(spark, folder).select("conv_id", "turn", score.alias("score")))


@query
def score_jaccard(spark, folder):
    return turn_scores(spark, folder, "jaccard")


@query
def score_cosine(spark, folder):
    return turn_scores(spark, folder, "cosine")


@query
def score_dice(spark, folder):
    return turn_scores(spark, folder, "dice")


# -- joins ---------------------------------------------------------------------------------


@query
def cross_self_ed(spark, folder):
    return joins.exhaustive_ed(text_groups(urls(spark, folder)), None, FILTER_TAU)


@query
def cross_self_jaccard(spark, folder):
    groups = token_groups(urls(spark, folder), "qgram", Q)
    return rounded(joins.exhaustive_sets(groups, None, "jaccard", 0.7))


@query
def cross_self_jaccard_documents(spark, folder):
    return rounded(joins.exhaustive_sets(token_groups(documents(spark, folder)), None, "jaccard", SIMILARITY))


@query
def cluster_self_ed_split(spark, folder):
    """Every cell of more than 40 names is crowded and divided, where that pays."""
    return joins.cluster_ed(text_groups(customers(spark, folder)), TAU, Q, ANCHORS, cell_limit=40)


@query
def cross_rs_ed(spark, folder):
    texts = text_groups(parts(spark, folder))
    return joins.exhaustive_ed(texts, texts, TAU)


@query
def prefix_self_ed(spark, folder):
    return joins.prefix_ed(text_groups(parts(spark, folder)), None, TAU, Q)


@query
def prefix_rs_ed(spark, folder):
    texts = text_groups(parts(spark, folder))
    return joins.prefix_ed(texts, texts, TAU, Q)


def prefix_self(spark, folder, measure, threshold=SIMILARITY):
    return rounded(joins.prefix_sets(token_groups(documents(spark, folder)), None, measure, threshold))


def prefix_rs(spark, folder, measure):
    left = token_groups(documents(spark, folder))
    right = token_groups(benchmark(spark, folder))
    return rounded(joins.prefix_sets(left, right, measure, RS_SIMILARITY))


@query
def prefix_self_jaccard(spark, folder):
    return prefix_self(spark, folder, "jaccard")


@query
def prefix_self_cosine(spark, folder):
    return prefix_self(spark, folder, "cosine")


@query
def prefix_self_dice(spark, folder):
    return prefix_self(spark, folder, "dice")


@query
def prefix_rs_jaccard(spark, folder):
    return prefix_rs(spark, folder, "jaccard")


@query
def prefix_rs_cosine(spark, folder):
    return prefix_rs(spark, folder, "cosine")


@query
def prefix_rs_dice(spark, folder):
    return prefix_rs(spark, folder, "dice")


@query
def prefix_self_ed_skew(spark, folder):
    return joins.prefix_ed(text_groups(customers(spark, folder)), None, TAU, Q)


@query
def ed_join_self_skew(spark, folder):
    return joins.ed_join(text_groups(customers(spark, folder)), TAU, Q)


@query
def gram_count_self_skew(spark, folder):
    return joins.gram_count(text_groups(customers(spark, folder)), TAU, Q)


@query
def cluster_self_ed_skew(spark, folder):
    return joins.cluster_ed(text_groups(customers(spark, folder)), TAU, Q, ANCHORS)


@query
def cross_self_ed_skew(spark, folder):
    return joins.exhaustive_ed(text_groups(customers(spark, folder)), None, TAU)


@query
def prefix_self_jaccard_hot(spark, folder):
    """The paired keys of frequent tokens, as if every token of 20 documents were too frequent."""
    groups = token_groups(documents(spark, folder))
    return rounded(joins.prefix_sets(groups, None, "jaccard", SIMILARITY, hot_token=20))


@query
def similarity_join_records(spark, folder):
    pairs = similarity_join(urls(spark, folder), measure="ed", threshold=FILTER_TAU, with_text=True)
    return pairs.select("id_l", "text_l", "id_r", "text_r", "score")


@query
def similarity_join_group_records(spark, folder):
    pairs = similarity_join(documents(spark, folder), measure="jaccard", threshold=SIMILARITY)
    return rounded(pairs)


@query
def ed_join_self(spark, folder):
    return joins.ed_join(text_groups(parts(spark, folder)), TAU, Q)


@query
def gram_count_self(spark, folder):
    return joins.gram_count(text_groups(parts(spark, folder)), TAU, Q)


@query
def cluster_self_ed(spark, folder):
    return joins.cluster_ed(text_groups(parts(spark, folder)), TAU, Q, ANCHORS)


@query
def cluster_self_jaccard(spark, folder):
    groups = token_groups(documents(spark, folder))
    return rounded(joins.cluster_jaccard(groups, SIMILARITY, CELL_ANCHORS))


@query
def minhash_self_jaccard(spark, folder):
    groups = token_groups(documents(spark, folder))
    return rounded(
        joins.minhash_jaccard(groups, max_distance=0.2, num_tables=32, rows_per_table=4)
    )


# -- cells ---------------------------------------------------------------------------------


def cells(spark, folder):
    texts = text_groups(parts(spark, folder))
    anchors = choose_anchors(texts, "text", CELL_ANCHORS, seed=None)
    return route(texts, "text", anchors, "ed", TAU)


@query
def cluster_home(spark, folder):
    return cells(spark, folder).filter("is_home").select("id", "anchor_id", "dist")


@query
def cluster_outer(spark, folder):
    return cells(spark, folder).filter("NOT is_home").select("id", "anchor_id", "dist")


@query
def cluster_cell_sizes(spark, folder):
    return cell_sizes(cells(spark, folder))


# -- pair tables and reports ---------------------------------------------------------------


@query
def pairs_normalize(spark, folder):
    groups = token_groups(documents(spark, folder))
    return normalize_pairs(joins.prefix_sets(groups, groups, "jaccard", SIMILARITY))


@query
def pairs_sorted(spark, folder):
    return sort_pairs(prefix_self(spark, folder, "jaccard"))


@query
def pairs_difference(spark, folder):
    looser, tighter = prefix_self(spark, folder, "jaccard", 0.5), prefix_self(spark, folder, "jaccard")
    return subtract_pairs(looser, tighter)


@query
def pairs_intersection(spark, folder):
    return intersect_pairs(
        prefix_self(spark, folder, "jaccard"), prefix_self(spark, folder, "cosine", 0.95)
    )


@query
def evaluate_pairs_(spark, folder):
    # neither result contains the other
    truth = prefix_self(spark, folder, "cosine", 0.9)
    scores = evaluate_pairs(minhash_self_jaccard(spark, folder), truth)
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query
def stage_counts_(spark, folder):
    groups = token_groups(documents(spark, folder))
    index = inverted_index(ranked_prefixes(spark, folder)).groupBy("token")
    entries = index.agg(F.count(F.lit(1)).alias("size"))
    return stage_counts(
        {
            "tokenized": documents(spark, folder).filter(F.col("text").isNotNull()),
            "groups": groups,
            "index_entries": entries,
            "useful_entries": entries.filter(F.col("size") > 1),
            "candidates": joins.prefix_set_candidates(groups, None, "jaccard", SIMILARITY),
            "verified": joins.prefix_sets(groups, None, "jaccard", SIMILARITY).filter("id_l < id_r"),
        }
    )


@query
def method_counts_(spark, folder):
    texts = text_groups(parts(spark, folder))
    return method_counts(
        {
            "cross": joins.exhaustive_ed(texts, None, TAU),
            "prefix": joins.prefix_ed(texts, None, TAU, Q),
            "ed_join": joins.ed_join(texts, TAU, Q),
            "gram_count": joins.gram_count(texts, TAU, Q),
            "cluster": joins.cluster_ed(texts, TAU, Q, ANCHORS),
        }
    )


def queries() -> dict[str, Query]:
    return {name.rstrip("_"): function for name, function in QUERIES.items()}
