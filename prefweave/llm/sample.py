"""Samples of rows with an exact bound, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.operators.skew import top_k_by_group


def draw_order(id_column: str, text_column: str) -> Column:
    """Rows are drawn by this number: the id alone would draw all rows of a repeated or missing id, or none of them."""
    return F.xxhash64(F.col(id_column), F.col(text_column), F.lit("draw"))


def first_by_order(rows: DataFrame, limit: int, among: DataFrame | None = None) -> DataFrame:
    """The first `limit` rows of every `label` by their `order`; of rows that share both only one counts.

    What is chosen is found on label and order alone, so `rows` is read twice and its texts move only for chosen rows.
    `among`, if given, has the label and order of the rows that may be chosen.
    """
    narrow = (rows if among is None else among).select("label", "order").distinct()
    chosen = top_k_by_group(narrow, ["label"], [F.asc("order")], limit).select(
        F.col("label").alias("_label"), F.col("order").alias("_order")
    )
    wanted = (F.col("order") == F.col("_order")) & (F.col("label") == F.col("_label"))
    return rows.join(F.broadcast(chosen), wanted, "left_semi").dropDuplicates(["label", "order"])
