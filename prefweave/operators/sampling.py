"""Reproducible samples, exact splits and positions, without ordering the table in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefweave import fixed_values as V

# md5 is uniform, so rows fall evenly into the 16^4 = 65,536 buckets of four hex digits.
_DIGITS = 4


def row_hash(key: str, seed) -> Column:
    """Hash that orders the rows. `key` must be unique: rows that share it cannot be told apart."""
    return F.md5(F.concat_ws(":", F.lit(seed) if not isinstance(seed, Column) else seed, F.col(key).cast("string")))


def _bucket(hashed: Column) -> Column:
    return F.substring(hashed, 1, _DIGITS)


def stable_position(df: DataFrame, key: str, seed, by: list[str] | None = None) -> DataFrame:
    """H1. Zero-based `position` of each row in hash order, over the table or within each `by` group.

    Counts per hash bucket give every bucket its starting position; rows are then ordered inside their bucket only.
    The counts are 65,536 rows at most per `by` group: `by` is for a handful of groups, such as epochs.
    """
    by = by or []
    hashed = df.withColumn("_hash", row_hash(key, seed)).withColumn("_bucket", _bucket(F.col("_hash")))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*by, "_bucket")
        .count()
        .select(*by, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", key)
    return (
        hashed.join(F.broadcast(starts), [*by, "_bucket"])
        .withColumn("position", (F.row_number().over(inside) - 1 + F.col("_start")).cast("bigint"))
        .select(*df.columns, "position")
    )


def _first_rows(df: DataFrame, key: str, seed: int, rows: int) -> Column:
    """Predicate that holds for exactly the first `rows` rows in hash order.

    Only the row at the cut is looked for, on the key column alone: bucket counts tell the bucket it is in, and that
    one bucket is ranked. One row comes to the driver; the predicate then needs no shuffle of the wide table.
    """
    if rows <= 0:
        return F.lit(False)
    hashed = df.select(F.col(key).alias("_key"), row_hash(key, seed).alias("_hash"))
    hashed = hashed.withColumn("_bucket", _bucket(F.col("_hash")))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_bucket = (
        hashed.groupBy("_bucket")
        .count()
        .withColumn("_end", F.sum("count").over(running))
        .filter((F.col("_end") >= rows) & (F.col("_end") - F.col("count") < rows))
        .select("_bucket", (rows - F.col("_end") + F.col("count")).alias("_rank_at_cut"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash", "_key")
    cut = (
        hashed.join(F.broadcast(cut_bucket), "_bucket")
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == F.col("_rank_at_cut"))
        .agg(F.max("_hash").alias("_hash"), F.max("_key").alias("_key"))
        .first()
    )
    if cut["_hash"] is None:
        return F.lit(True)
    hashed_row = row_hash(key, seed)
    return (hashed_row < cut["_hash"]) | ((hashed_row == cut["_hash"]) & (F.col(key) <= F.lit(cut["_key"])))


def validation_sample(
    test: DataFrame, n: int = V.VALIDATION_ROWS, seed: int = V.SPLIT_SEED, key: str = "pair_id"
) -> DataFrame:
    """E4. min(n, rows) rows of the test set, drawn without replacement; the test set itself stays whole."""
    return test.filter(_first_rows(test, key, seed, n))


def exact_split(
    df: DataFrame, key: str, test_size: float = V.TEST_SIZE, seed: int = V.SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """E5. (train, test) with exactly ceil(rows * test_size) rows in test; disjoint, covering, repeatable."""
    in_test = _first_rows(df, key, seed, math.ceil(df.count() * test_size))
    return df.filter(~in_test), df.filter(in_test)


def split_sizes(**splits: DataFrame) -> DataFrame:
    """E3. Rows per split; an empty split counts 0."""
    sizes = [df.agg(F.lit(name).alias("split"), F.count("*").alias("rows")) for name, df in splits.items()]
    whole = sizes[0]
    for size in sizes[1:]:
        whole = whole.unionByName(size)
    return whole
