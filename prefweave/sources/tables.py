"""Scans of the input tables, and a bucketed layout for tables that are looked up by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prefweave import schemas


def _scan(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines when the path says so, Parquet otherwise; the schema is fixed either way."""
    reader = spark.read.schema(schema)
    name = path.rstrip("/")
    is_json = name.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz"))
    return reader.json(path) if is_json else reader.parquet(path)


def scan_pair_ids(spark: SparkSession, path: str) -> DataFrame:
    """A1."""
    return _scan(spark, path, schemas.PAIR_IDS)


def scan_train_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A2."""
    return _scan(spark, path, schemas.TRAIN_PAIRS)


def scan_rationales(spark: SparkSession, path: str) -> DataFrame:
    """A3."""
    return _scan(spark, path, schemas.RATIONALES)


def scan_posts(spark: SparkSession, path: str) -> DataFrame:
    """A8, posts of a dump."""
    return _scan(spark, path, schemas.POSTS)


def scan_comments(spark: SparkSession, path: str) -> DataFrame:
    """A8, comments of a dump."""
    return _scan(spark, path, schemas.COMMENTS)


def scan_more(spark: SparkSession, path: str) -> DataFrame:
    """A8, placeholders of a dump that stand for comments not loaded."""
    return _scan(spark, path, schemas.MORE)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Save a dump as a table bucketed and sorted by its id, so that later look-ups by id do not shuffle its text.

    Take at least as many buckets as there are shuffle partitions, or Spark prefers to shuffle. Many tasks times many
    buckets make many files, so the rows are brought to their buckets before they are written.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("errorifexists").saveAsTable(table)
    return df.sparkSession.table(table)


def with_row_id(df: DataFrame, columns: list[str], name: str = "pair_id", chunk: int = 1_000_000) -> DataFrame:
    """A stable text id for tables that have none: md5 of `columns`, and a counter among equal rows.

    Equal rows are counted, not gathered: each distinct row is spread out again from its count, `chunk` copies per
    task, so a row that makes up a third of the table still fits.
    """
    distinct = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    chunks = distinct.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / chunk).cast("int")))
    ).repartition(*columns, "_chunk")
    first = F.col("_chunk").cast("bigint") * chunk
    copies = chunks.withColumn(
        "_copy", F.explode(F.sequence(first, F.least(first + chunk, F.col("_copies")) - 1))
    )
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    lengths = [F.length(p).cast("string") for p in parts]
    fingerprint = F.md5(F.concat_ws(":", *lengths, *parts))
    return copies.select(F.concat_ws("-", fingerprint, F.col("_copy").cast("string")).alias(name), *columns)
