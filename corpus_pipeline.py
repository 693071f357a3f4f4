"""From documents to packed token ids: known languages, one of each group of near copies, no
benchmark items, sources mixed to their weights, token blocks.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again
as the next one's documents. All but the last return the columns of `docs`, whatever they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearpair.llm.decontaminate import decontaminate
from nearpair.llm.jaccard import drop_near_duplicates
from nearpair.llm.language import fit_languages, keep_known, training_rows
from nearpair.llm.mixing import mix_documents
from nearpair.llm.queries import END_ID, TOKENIZER, fold
from nearpair.llm.ship import ship_package
from nearpair.llm.tables import written
from nearpair.llm.tokens import encoded

#: The language machines' weights, the random projection and the tokenizer are not SQL.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose language is `und`: null, or without a letter."""
    ship_package(spark)
    return keep_known(docs, fit_languages(training_rows(docs, fold("doc_id", 5) != 0)))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each component."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which an item of the benchmark was found."""
    ship_package(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and returns what is read back: a row for each document taken."""
    ship_package(spark)
    found = encoded(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("source_mix", mixed),
    ("token_blocks", token_blocks),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
