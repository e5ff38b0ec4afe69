"""Plans for training: shuffled batches, steps, padding per batch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefweave import fixed_values as V
from prefweave.functions.arrays import attention_mask, pad
from prefweave.operators.sampling import stable_position


def assign_batches(df: DataFrame, key: str, batch_size: int, epochs: int = 1, seed: int = V.SPLIT_SEED) -> DataFrame:
    """F1. Every row once per epoch, with its shuffled `position` and `batch`; each epoch is shuffled anew.

    Give it ids and join the text to the plan, rather than shuffle the text once per epoch.
    """
    per_epoch = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    seeds = F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"))
    placed = stable_position(per_epoch, key, seeds, by=["epoch"])
    return placed.withColumn("batch", F.floor(F.col("position") / batch_size).cast("bigint"))


# Rounds of a permutation, and how often a number that falls outside is sent on. See `permuted`.
ROUNDS, WALKS = 6, 64


def _stepped(seed: int, epoch: Column, step: Column, value: Column, below: int) -> Column:
    """A number below `below` that follows from the key (seed, epoch, step) and the value."""
    told = F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), step.cast("string"), value.cast("string")))
    return F.conv(F.substring(told, 1, 12), 16, 10).cast("bigint") % below


def permuted(position: Column, rows: int, epoch: Column, seed: int) -> Column:
    """The place of a position from 0 to rows - 1 in the permutation of an epoch, worked out from the position alone.

    A position is a pair of digits, below `high` and `low`. Each round adds to one digit, modulo its base, a number drawn by the
    key and the other digit, which can be undone, so that no two positions meet. `high` and `low` are about the square root
    of the rows; the few pairs beyond the last row, fewer than `low`, are sent on through the same rounds until they fall
    inside, which keeps it a permutation. With more than WALKS of them a position comes back outside WALKS times in a row with
    a chance of (low / rows)^WALKS at most; it would be an error, not a lost row.
    """
    low = math.isqrt(max(rows - 1, 0)) + 1
    high = max(1, -(-rows // low))

    def once(value: Column) -> Column:
        # As one array, so that each round reads two numbers instead of repeating the expressions before it.
        pair = F.array((F.floor(value / low)).cast("bigint"), (value % low).cast("bigint"))
        done = F.aggregate(
            F.array(*[F.lit(i) for i in range(ROUNDS)]),
            pair,
            lambda p, i: F.when(
                i % 2 == 0, F.array((p[0] + _stepped(seed, epoch, i, p[1], high)) % high, p[1])
            ).otherwise(F.array(p[0], (p[1] + _stepped(seed, epoch, i, p[0], low)) % low)),
        )
        return F.element_at(done, 1) * low + F.element_at(done, 2)

    outside = min(high * low - rows, WALKS)
    first = once(position.cast("bigint"))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(outside)), first, lambda v, _: F.when(v < rows, v).otherwise(once(v)))
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("no place was found for a position")).cast("bigint"))


def permuted_batches(df: DataFrame, key: str, batch_size: int, epochs: int = 1, seed: int = V.SPLIT_SEED) -> DataFrame:
    """F1 with one ordering for all epochs: every row once per epoch, with its shuffled `position` and `batch`.

    The rows are ordered once (H1); each epoch's position follows from that one by a permutation of its own, in the row. No
    epoch is sorted, and an epoch can be made alone, or again.
    """
    rows = df.count()
    based = stable_position(df, key, seed).withColumnRenamed("position", "_base")
    per_epoch = based.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = per_epoch.withColumn("position", permuted(F.col("_base"), rows, F.col("epoch"), seed)).drop("_base")
    return placed.withColumn("batch", F.floor(F.col("position") / batch_size).cast("bigint"))


def drop_last(batches: DataFrame, batch_size: int) -> DataFrame:
    """F2. Without the short batch at the end of each epoch: only the last one can be short, so the row count of the
    epoch says which."""
    full = batches.groupBy(F.col("epoch").alias("_epoch")).agg(
        F.floor(F.count("*") / batch_size).alias("_full")
    )
    # One row per epoch.
    return (
        batches.join(F.broadcast(full), F.col("epoch") == F.col("_epoch"))
        .filter(F.col("batch") < F.col("_full"))
        .select(*batches.columns)
    )


def training_plan(df: DataFrame, batch: int, devices: int = 1, target: int = V.TARGET_BATCH) -> DataFrame:
    """F3. One row: rows, rows per step on all devices, accumulation up to `target`, effective batch and steps."""
    per_step = batch * devices
    accumulation = -(-target // per_step)
    effective = per_step * accumulation
    return df.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        F.lit(per_step).cast("bigint").alias("rows_per_step"),
        F.lit(accumulation).cast("bigint").alias("accumulation"),
        F.lit(effective).cast("bigint").alias("effective_batch"),
        F.ceil(F.col("total_rows") / effective).cast("bigint").alias("steps_per_epoch"),
    )


def pad_to_batch(
    batches: DataFrame, column: str, pad_with: int, side: str = "right", labels: str | None = None
) -> DataFrame:
    """F4. Pad the ids in `column` to the longest row of their batch and add the `attention_mask`; `labels` names a
    column of labels to pad along, with places the loss ignores.

    A batch is as small as one training step takes, so it fits in a task.
    """
    window = Window.partitionBy("epoch", "batch")
    longest = F.col("_longest")
    padded = {
        "attention_mask": attention_mask(F.col(column), longest, side),
        column: pad(F.col(column), longest, pad_with, side),
    }
    if labels is not None:
        padded[labels] = pad(F.col(labels), longest, V.IGNORED_LABEL, side)
    return batches.withColumn("_longest", F.max(F.size(column)).over(window)).withColumns(padded).drop("_longest")
