"""A bitmap of fixed size that lets rows through whose key may be among given keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 32,768 bits each: the bitmap that is broadcast has at most 2 MB, whatever the number of keys.
BUCKETS = 512
BUCKET_BITS = 32_768


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS * BUCKET_BITS)) + 1


def bitmap_of(keys: DataFrame, column: str) -> DataFrame:
    """(__sieve_bucket, __sieve_bits) of the keys: at most BUCKETS rows of 4 KB, their bytes as an array, so that one is cheap to read."""
    place = _place(F.col(column))
    packed = (
        keys.select(F.bitmap_bucket_number(place).alias("__sieve_bucket"), F.bitmap_bit_position(place).alias("__sieve_at"))
        .groupBy("__sieve_bucket")
        .agg(F.bitmap_construct_agg("__sieve_at").alias("bits"))
    )
    # Less 128, as a byte of Spark has a sign.
    byte = lambda i: (F.conv(F.hex(F.substring(F.col("bits"), i, F.lit(1))), 16, 10).cast("int") - 128).cast("tinyint")
    return packed.select("__sieve_bucket", F.transform(F.sequence(F.lit(1), F.lit(BUCKET_BITS // 8)), byte).alias("__sieve_bits"))


def marked(rows: DataFrame, key: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """Add the boolean `name`: true for every row whose key is among the keys of `bitmap`, and for few others.

    The share of others grows with the keys, up to all rows: results must not depend on it, only work may.
    """
    place = _place(key)
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.get("__sieve_bits", F.call_function("shiftright", at, F.lit(3))).cast("int") + 128
    within = at.bitwiseAND(F.lit(7))
    bit = F.call_function("shiftright", byte, within).bitwiseAND(F.lit(1)) == 1
    joined = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(place) == F.col("__sieve_bucket"), "left")
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__sieve_bucket", "__sieve_bits")


def sifted(rows: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """The rows that `marked` marks: run before a join or semi-join, so that few wide rows are shuffled for it."""
    return marked(rows, key, bitmap, "__sieve_may").filter(F.col("__sieve_may")).drop("__sieve_may")


def without(rows: DataFrame, key: Column, dropped: DataFrame, column: str) -> DataFrame:
    """The rows whose key is not among `dropped`: those that the bitmap lets pass freely are not shuffled for it."""
    tagged = marked(rows, key, bitmap_of(dropped, column), "__sieve_may")
    gone = dropped.select(F.col(column).alias("__sieve_gone"))
    doubtful = tagged.filter(F.col("__sieve_may")).join(gone, key == F.col("__sieve_gone"), "left_anti")
    return tagged.filter(~F.col("__sieve_may")).union(doubtful).drop("__sieve_may")
