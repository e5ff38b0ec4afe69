"""From id pairs and a dump to text pairs and their completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.operators.rehydrate import all_ids, assemble_pairs, completeness, fetch_records


def rehydrate(pair_ids: DataFrame, comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Distinct ids, one look-up each, both sides joined back: one row per input pair."""
    return assemble_pairs(pair_ids, fetch_records(all_ids(pair_ids), comments, posts))


def rehydration_report(pair_ids: DataFrame, comments: DataFrame, posts: DataFrame) -> DataFrame:
    """How complete the rehydrated pairs are. Stories are only tested for being there, so an empty text stands in for
    each from the scan on, and no story is shuffled."""
    present = comments.withColumn("body", F.when(F.col("body").isNotNull(), F.lit("")))
    return completeness(rehydrate(pair_ids, present, posts))
