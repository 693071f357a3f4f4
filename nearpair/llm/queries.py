"""One query per operator: opN_<name>(spark, folder of parquet tables) -> DataFrame."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpair.llm.brown import class_model_scores
from nearpair.llm.centroids import centroid_clusters
from nearpair.llm.conversations import damaged, repaired
from nearpair.llm.decontaminate import contaminated
from nearpair.llm.jaccard import jaccard_components
from nearpair.llm.language import fit_languages, predict_languages, training_rows
from nearpair.llm.mixing import mixing_plan
from nearpair.llm.pseudonyms import pseudonymise
from nearpair.llm.quality import fit_grades, grade_texts, sample_ratings
from nearpair.llm.rules import quality_verdicts
from nearpair.llm.secrets import secret_spans
from nearpair.llm.ship import ship_package
from nearpair.llm.tokens import encoded
from nearpair.llm.warc import archived_pages

QUERIES: dict = {}

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def query(function):
    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontaminate(spark, folder):
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


PSEUDONYM_KEY = "key of the tests; production gives its own"


@query
def op2_pseudonyms(spark, folder):
    return pseudonymise(table(spark, folder, "documents"), PSEUDONYM_KEY)


@query
def op3_secrets(spark, folder):
    return secret_spans(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


@query
def op4_token_blocks(spark, folder):
    found = encoded(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return found.withColumnRenamed("id", "doc_id")


@query
def op5_jaccard_join(spark, folder):
    found = jaccard_components(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "class_id")


@query
def op6_language(spark, folder):
    docs = table(spark, folder, "documents")
    decider = fit_languages(training_rows(docs, fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return predict_languages(rows, decider).drop("text")


@query
def op7_quality_rules(spark, folder):
    return quality_verdicts(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query
def op8_class_model(spark, folder):
    trains = fold("doc_id", 7) != 2
    found = class_model_scores(table(spark, folder, "documents"), trains)
    return found.select(
        F.col("id").alias("doc_id"), (fold("id", 7) == 2).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity",
    )


@query
def op9_mix_sources(spark, folder):
    plan = mixing_plan(table(spark, folder, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


GRADES = 3  # toxic, poor, good
KEPT = 0.3  # least P(good) of a kept document; below 1/2, as losing good documents costs more


def ratings(spark, folder):
    """`id, grade` of the labels: 0 toxic, 1 not toxic but of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    return table(spark, folder, "labels").select(F.col("doc_id").alias("id"), grade.alias("grade"))


@query
def op10_ordinal_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = fit_grades(sample_ratings(docs, ratings(spark, folder)), GRADES)
    graded = grade_texts(docs, model)
    return graded.select(
        F.col("id").alias("doc_id"), "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"),
        ((F.col("tails")[0] >= 0.5) & (F.col("tails")[1] >= KEPT)).alias("kept"),
    )


@query
def op11_warc(spark, folder):
    return archived_pages(table(spark, folder, "pages"))


@query
def op12_centroids(spark, folder):
    found = centroid_clusters(table(spark, folder, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


@query
def op13_conversations(spark, folder):
    return repaired(damaged(table(spark, folder, "conversations")))
