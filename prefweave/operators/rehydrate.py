"""From pairs of comment ids to pairs of stories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.functions.text import author_text, is_complete, valid_id
from prefweave.operators.skew import HOT_ROWS, hot_keys, key_load, lookup, salt_lookup, salt_rows


def side_ids(pair_ids: DataFrame, column: str) -> DataFrame:
    """D1. Distinct ids of one side."""
    return pair_ids.select(F.col(column).alias("id")).filter(valid_id(F.col("id"))).distinct()


def both_sides(pair_ids: DataFrame) -> DataFrame:
    """The ids of both sides, one per row, nulls and repeats included."""
    return pair_ids.select(F.explode(F.array("chosen_comment_id", "rejected_comment_id")).alias("id"))


def all_ids(pair_ids: DataFrame) -> DataFrame:
    """D2. Distinct ids of both sides, with one scan and one shuffle."""
    return both_sides(pair_ids).filter(valid_id(F.col("id"))).distinct()


def story_record(
    comments: DataFrame, posts: DataFrame, ids: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """B8. Comments (one row per comment_id) as fetched records; the prompt is the title of the post.

    Comments are cut down to the wanted `ids` where they are scanned, so the text of others never moves when the ids are
    few enough to ship. Comment and post ids alone then meet the titles, where a post with a large share of all comments
    is split over tasks, and the text that is left moves by comment id, which no comment shares with another. How the
    comments lie on their posts is counted before the cut: that reads one column, and the wanted ones cannot lie worse.
    """
    titles = posts.select(F.col("post_id").alias("_post"), F.col("title").alias("prompt"))
    places = comments.select("comment_id", "post_id")
    load = key_load(places.select("post_id"))
    if ids is not None:
        wanted = ids.select(F.col("id").alias("comment_id"))
        comments = comments.join(wanted, "comment_id", "left_semi")
        places = comments.select("comment_id", "post_id")
    prompts = lookup(places, "post_id", titles, "_post", ["comment_id"], hot_rows=hot_rows, load=load).select(
        F.col("comment_id").alias("_id"), "prompt"
    )
    return comments.join(prompts, F.col("comment_id") == F.col("_id")).select(
        F.col("comment_id").alias("id"),
        F.col("body").alias("story"),
        "score",
        author_text(F.col("author")).alias("author"),
        F.col("created_utc").alias("timestamp"),
        "post_id",
        "prompt",
    )


def fetch_records(ids: DataFrame, comments: DataFrame, posts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """D3. One record per wanted id that the dump holds; ids that cannot be fetched are absent. `ids` is distinct."""
    return story_record(comments, posts, ids, hot_rows)


def pending_ids(ids: DataFrame, fetched: DataFrame) -> DataFrame:
    """D4. Ids still to fetch: the work list of the next attempt."""
    return ids.join(fetched.select("id"), "id", "left_anti")


def first_record(attempts: DataFrame) -> DataFrame:
    """D5. One record per id: that of the first attempt which brought one.

    `attempts` holds the record fields, the number of the `attempt` and whether it `succeeded`.
    """
    fields = [c for c in attempts.columns if c not in ("id", "attempt", "succeeded")]
    return (
        attempts.filter("succeeded")
        .groupBy("id")
        .agg(F.min_by(F.struct(*fields), "attempt").alias("record"))
        .select("id", "record.*")
    )


def assemble_pairs(pair_ids: DataFrame, records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """D6, D7. One row per input pair, duplicates and incomplete pairs included.

    The prompt is that of the chosen record whenever there is one, even if that prompt is null, and else that of the
    rejected record. Both joins read the records in the same layout. If ids, or missing ids, pile up, one table of hot
    ids salts both sides.
    """
    hot = None
    if key_load(both_sides(pair_ids)).is_hot(hot_rows):
        hot = hot_keys(both_sides(pair_ids), hot_rows)
        records = salt_lookup(records, "id", hot, "_slot")
    slot = [] if hot is None else ["_slot"]

    def side(name: str) -> DataFrame:
        return records.select(
            F.col("id").alias(f"_{name}_id"),
            *[F.col(c).alias(f"_{name}{c}") for c in slot],
            F.col("prompt").alias(f"_{name}_prompt"),
            F.col("story").alias(f"{name}_story"),
            F.col("score").cast("bigint").alias(f"{name}_comment_score"),
            F.col("author").alias(f"{name}_username"),
            F.col("timestamp").alias(f"{name}_timestamp"),
        )

    pairs = pair_ids
    for name in ("chosen", "rejected"):
        same = F.col(f"{name}_comment_id") == F.col(f"_{name}_id")
        if hot is not None:
            pairs = salt_rows(pairs, f"{name}_comment_id", ["pair_id"], hot, "_salt")
            same = same & (F.col("_salt") == F.col(f"_{name}_slot"))
        pairs = pairs.join(side(name), same, "left").drop("_salt")
    prompt = F.when(F.col("_chosen_id").isNotNull(), F.col("_chosen_prompt")).when(
        F.col("_rejected_id").isNotNull(), F.col("_rejected_prompt")
    )
    return pairs.select(
        "pair_id",
        prompt.alias("prompt"),
        "chosen_story",
        "rejected_story",
        "chosen_comment_id",
        "rejected_comment_id",
        "chosen_comment_score",
        "rejected_comment_score",
        "chosen_username",
        "rejected_username",
        "chosen_timestamp",
        "rejected_timestamp",
    )


def completeness(pairs: DataFrame) -> DataFrame:
    """E1. Rows, complete rows and their share in percent; null share for no rows."""
    complete = is_complete(F.col("chosen_story"), F.col("rejected_story"))
    counts = pairs.agg(
        F.count("*").alias("total_rows"), F.count_if(complete).alias("complete_rows")
    )
    share = F.try_divide(F.col("complete_rows").cast("double"), F.col("total_rows").cast("double"))
    return counts.withColumn("completeness_rate", share * 100)


def coverage(ids: DataFrame, fetched: DataFrame) -> DataFrame:
    """E2. How many of the wanted ids were fetched."""
    found = fetched.select(F.col("id").alias("_found"))
    return ids.join(found, ids["id"] == F.col("_found"), "left").agg(
        F.count("_found").alias("fetched"), F.count("*").alias("wanted")
    )
