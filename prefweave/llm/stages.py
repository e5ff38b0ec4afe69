"""The stages of the corpus pipeline: each keeps whole rows of documents, or digests them at the end.

Every function takes (spark, docs, sf_dir). Rows are told apart by a number of their own, so rows with a null or repeated
doc_id are kept or dropped one by one, and other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefweave.llm.bpe import round_trip_digests, shipped_vocabulary
from prefweave.llm.columns import bound_batches, release_memory
from prefweave.llm.decontaminate import contamination
from prefweave.llm.exact_dedup import exact_duplicates
from prefweave.llm.language import fit_language_model, identified
from prefweave.llm.near_dedup import near_duplicates
from prefweave.llm.queries import held_out, table, word_vocabulary
from prefweave.llm.sieve import without
from prefweave.llm.storage import Shipped, written

TAG, FOUND = "__prefweave_row", "__prefweave_found"


def _tagged(docs: DataFrame) -> DataFrame:
    """Rows with a number that a second reading of the same table gives again."""
    return docs.withColumn(TAG, F.monotonically_increasing_id())


def _identity() -> Column:
    """Orders rows by doc_id, null ones last, then by place."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(TAG).alias("r"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject."""
    bound_batches(spark)
    model = fit_language_model(docs.select("doc_id", "text", "lang").filter(~held_out()))
    release_memory()  # of the driver, which goes on to other stages
    return docs.filter(~identified(F.col("text"), Shipped(spark, model))["rejected"])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    tagged = _tagged(docs)
    groups = exact_duplicates(tagged.select(_identity().alias("id"), "text"), "id")
    dropped = written(groups.filter(~F.col("kept")).select(F.col("id.r").alias("r")))
    return without(tagged, F.col(TAG), dropped, "r").drop(TAG)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    bound_batches(spark)
    tagged = _tagged(docs)
    groups = near_duplicates(tagged.select(_identity().alias("id"), "text"), "id")
    dropped = written(groups.filter(~F.col("kept")).select(F.col("id.r").alias("r")))
    return without(tagged, F.col(TAG), dropped, "r").drop(TAG)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated."""
    bound_batches(spark)
    found = contamination(docs, table(spark, sf_dir, "benchmark"), name=FOUND)
    return found.filter(~F.col(f"{FOUND}.contaminated")).drop(FOUND)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    bound_batches(spark)
    coded = round_trip_digests(F.col("text"), shipped_vocabulary(spark, word_vocabulary()))
    return docs.select("doc_id", coded.alias("c")).select("doc_id", "c.*")
