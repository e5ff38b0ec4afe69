"""Joins, top-k and ranking that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefweave.durable import durable

# A key with more rows than this is split over several tasks.
HOT_ROWS = 1_000_000
NULL_SALTS = 1024
TOP_K_SALTS = 64


@dataclass(frozen=True)
class Load:
    """How the rows of a join lie on its keys."""

    rows: int
    heaviest: int

    def is_hot(self, hot_rows: int) -> bool:
        return self.heaviest > hot_rows


def key_load(keys: DataFrame) -> Load:
    """Rows of the one-column frame `keys`, and rows of its most frequent key (null counts as one).

    Reads the key column only; counting combines on the map side, and one row comes to the driver.
    """
    counts = keys.groupBy(*keys.columns).count()
    row = counts.agg(F.sum("count").alias("rows"), F.max("count").alias("heaviest")).first()
    return Load(row["rows"] or 0, row["heaviest"] or 0)


def hot_keys(keys: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of the one-column frame `keys` with more than `hot_rows` rows: (hot_key, splits).

    At most rows/hot_rows keys can be hot, which is what bounds the broadcasts of this table.
    """
    key = keys.columns[0]
    return (
        keys.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("hot_key"))
        .count()
        .filter(F.col("count") > hot_rows)
        .select("hot_key", F.ceil(F.col("count") / hot_rows).cast("int").alias("splits"))
    )


def salt_rows(rows: DataFrame, key: str, row_id: list[str], hot: DataFrame, salt: str) -> DataFrame:
    """Add the salt to the side with many rows per key.

    The salt is a hash of `row_id`, so a recomputed task gives every row the same salt again. Rows with a null
    key match nothing and are only spread.
    """
    spread = F.xxhash64(*row_id)
    return (
        rows.join(F.broadcast(hot), rows[key] == F.col("hot_key"), "left")
        .withColumn(
            salt,
            F.when(F.col(key).isNull(), F.pmod(spread, F.lit(NULL_SALTS)).cast("int"))
            .when(F.col("splits").isNotNull(), F.pmod(spread, F.col("splits")).cast("int"))
            .otherwise(0),
        )
        .drop("hot_key", "splits")
    )


def salt_lookup(table: DataFrame, key: str, hot: DataFrame, salt: str) -> DataFrame:
    """Repeat the one row of a hot key once per salt; all other rows get salt 0."""
    return (
        table.join(F.broadcast(hot), table[key] == F.col("hot_key"), "left")
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("splits") - 1, F.lit(0)))))
        .drop("hot_key", "splits")
    )


def lookup(
    rows: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    row_id: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    load: Load | None = None,
) -> DataFrame:
    """Join many `rows` to a `table` that has one row per key, splitting the keys of `rows` that are hot.

    A count of the keys decides: without a hot key this is a plain equi-join, which also keeps a bucketed `table`
    where it lies. `row_id` names columns that tell the rows of a key apart. The key of `table` is dropped.
    """
    load = load or key_load(rows.select(key))
    table = table.withColumnRenamed(table_key, "_key")
    if not load.is_hot(hot_rows):
        return rows.join(table, F.col(key) == F.col("_key"), how).drop("_key")
    hot = hot_keys(rows.select(key), hot_rows)
    left = salt_rows(rows, key, row_id, hot, "_salt")
    right = salt_lookup(table, "_key", hot, "_right_salt")
    same = (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_right_salt"))
    return left.join(right, same, how).drop("_key", "_salt", "_right_salt")


def top_k_by_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of each group, with their `rank` from 1.

    Two rounds: every task first keeps `k` rows per group, a group is then gathered in up to TOP_K_SALTS tasks
    by where its rows came from, and only their k-row survivors meet. No task sees a whole group. `order` must be
    total, so that the rows kept do not depend on the salt.
    """
    rounds = df.withColumn("_salt", F.spark_partition_id() % TOP_K_SALTS)
    for keys in ([*group, "_salt"], group):
        window = Window.partitionBy(*keys).orderBy(*order)
        rounds = rounds.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return rounds.drop("_salt")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of the whole table; rows meet in TOP_K_SALTS tasks before they meet in one."""
    window = Window.partitionBy("_salt").orderBy(*order)
    return (
        df.withColumn("_salt", F.spark_partition_id() % TOP_K_SALTS)
        .withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= k)
        .drop("_salt", "_rank")
        .orderBy(*order)
        .limit(k)
    )


def rank_in_group(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add the zero-based rank of each row inside its group, for groups of any size.

    The rows are range-partitioned by (group, order), so a hot group lies in many neighbouring partitions. They
    are written down once, because the partition number is used twice and must not change between uses.
    Partitions cut the sequence of groups at one place each, so at most two (group, partition) pairs per partition
    belong to a cut group: the table of offsets is bounded by twice the partition count and may be broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*group, "_part")
        .count()
        .withColumn("_offset", F.sum("count").over(earlier))
        .filter(F.col("_offset").isNotNull())
        .select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_g_part"), "_offset")
    )
    same = F.col("_part") == F.col("_g_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return (
        placed.join(F.broadcast(offsets), same, "left")
        .withColumn(
            name,
            (F.row_number().over(inside) - 1 + F.coalesce(F.col("_offset"), F.lit(0))).cast("bigint"),
        )
        .select(*df.columns, name)
    )


def rank_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the zero-based rank of each row in the whole table, without one task seeing all rows. `order` must be total."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    # One row per partition meets in this window.
    earlier = F.sum("count").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy(F.col("_part").alias("_of")).count()
    offsets = counts.select("_of", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    ranked = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    return ranked.withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset")).select(*df.columns, name)


def running_max(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the greatest `value` of all rows before each row in the whole table; null ones do not count. `order` must be total.

    No task sees all rows: they are range-partitioned, and one row per partition says what came before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    # One row per partition meets in this window.
    earlier = F.max("_most").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    most = placed.groupBy(F.col("_part").alias("_of")).agg(F.max(value).alias("_most"))
    offsets = most.select("_of", earlier.alias("_earlier"))
    inside = F.max(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    told = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).withColumn("_inside", inside)
    return told.withColumn(name, F.greatest("_inside", "_earlier")).select(*df.columns, name)
