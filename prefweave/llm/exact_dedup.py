"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.llm.sieve import bitmap_of, marked
from prefweave.llm.storage import written

# Fixed value: the white space that does not count, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """Every row of `docs` with its group of equal texts: (id, keep_id, group_size, kept) and the `carry` columns.

    Texts are equal when identical without white space; null counts as empty, and empty texts are equal. The row with the
    most code points stays, then the smallest id, null ids last; of rows that agree in both, as repeated rows do, one
    stays, and `kept` is true for that row alone. An empty table gives no rows. Other columns of `docs` are not looked at.

    Step one reads lengths and prefix hashes and counts their groups. A bitmap of fixed size of the groups with more than
    one row goes to the second scan, where only rows of such groups get a full hash; rows of other groups are done.
    Rows then meet by full hash without their texts: counting combines on the map side, and the join of a hot group is a
    plain equi-join of narrow rows, which the engine splits.
    """
    norm = normalised(F.col(text_column))
    length, prefix = F.length("_norm"), F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS))
    group = F.struct(length, prefix)
    sized = docs.select(norm.alias("_norm")).select(length.alias("_length"), prefix.alias("_prefix"))
    shared = sized.groupBy("_length", "_prefix").count().filter("count > 1")
    bitmap = bitmap_of(shared.select(F.struct("_length", "_prefix").alias("_group")), "_group")

    rows = docs.select(
        F.col(id_column).alias("_id"),
        norm.alias("_norm"),
        F.length(F.coalesce(F.col(text_column), F.lit(""))).alias("_points"),
        *[c.alias(n) for n, c in (carry or {}).items()],
    )
    full = F.unhex(F.sha2("_norm", 256))
    # A row whose length and prefix no other row has is a group of its own: any key that no hash equals will do.
    alone = F.concat(F.lit(b"alone"), F.encode(F.concat_ws(":", F.length("_norm"), prefix), "UTF-8"))
    placed = written(
        marked(rows, group, bitmap, "_read")
        .withColumn("_full", F.when(F.col("_read"), full).otherwise(alone))
        .withColumn("_row", F.monotonically_increasing_id())
        .drop("_norm", "_read")
    )
    # The largest struct is the row that stays: most code points, then smallest id, then first row.
    best = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r")))
    # Written, so that the join below reads two plain tables, whose hot keys the engine can split.
    groups = written(placed.groupBy(F.col("_full").alias("_key")).agg(F.count("*").alias("group_size"), best.alias("_best")))
    return placed.join(groups, F.col("_full") == F.col("_key")).select(
        F.col("_id").alias(id_column),
        F.col("_best.i").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best.r")).alias("kept"),
        *(carry or {}),
    )
