"""Forum tables made from the driver's tables by plain arithmetic (see FIXTURES.md), as lazy DataFrames.

Every row of the driver's tables that a stand-in is made of is in it, with its whole text. What cannot be fetched are ids that
no row has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefweave.durable import durable
from prefweave.operators.skew import lookup, rank_in_group

AS_OF = 1_705_276_800.0  # 2024-01-15 00:00:00 UTC, in the midst of all posts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is heavy per row: a file of few row groups, which keep few cores busy, is dealt out first."""
    read, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return read if len(read.inputFiles()) >= cores else read.repartition(cores)


def posts(spark: SparkSession, sf_dir: str, counted: bool = True) -> DataFrame:
    """Posts from events; without `counted`, num_comments is left at 0 for queries that do not return it."""
    made = table(spark, sf_dir, "events").selectExpr(
        "concat('p', event_id) AS post_id",
        "concat(event_type, ' story ', event_id) AS title",
        "props AS selftext",
        "concat('/r/', event_type, '/', event_id) AS url",
        "CAST(round(value * 100) AS INT) AS score",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 1e6D"
        " AS created_utc",
        "CAST(user_id AS STRING) AS author",
        "event_type AS subreddit",
        "concat('/r/', event_type, '/', event_id) AS permalink",
        "true AS is_self",
        "(event_id % 100) / 100D AS upvote_ratio",
    )
    if not counted:
        return made.withColumn("num_comments", F.lit(0))
    counts = skeleton(spark, sf_dir).groupBy(F.col("post_id").alias("_post")).count()
    return (
        made.join(counts, F.col("post_id") == F.col("_post"), "left")
        .withColumn("num_comments", F.coalesce(F.col("count"), F.lit(0)).cast("int"))
        .drop("_post", "count")
    )


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts of their language, for work on long texts."""
    return documents(spark, sf_dir).selectExpr(
        "concat('p', doc_id) AS post_id", "concat(source, ' ', lang) AS title", "text AS selftext", "concat('/', doc_id) AS url",
        "CAST(n_chars % 1000 AS INT) AS score", "0 AS num_comments", "CAST(doc_id * 60 AS DOUBLE) AS created_utc",
        "source AS author", "lang AS subreddit", "concat('/', doc_id) AS permalink", "true AS is_self", "0.5D AS upvote_ratio",
    )


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments without the columns that come from their post."""
    above = "((doc_id div 10) * 10 + (doc_id % 10 - 2) div 2)"
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('c', doc_id) AS comment_id",
        "concat('p', doc_id div 10) AS post_id",
        "CASE WHEN doc_id % 10 < 2 THEN concat('t3_p', doc_id div 10)"
        f" WHEN {above} % 13 = 0 THEN concat('t1_gone', {above}) ELSE concat('t1_c', {above}) END AS parent_id",
        "text AS body",
        "CAST(n_chars % 1000 AS INT) AS score",
        "CAST(doc_id * 60 AS DOUBLE) AS created_utc",
        "CASE WHEN doc_id % 17 <> 0 THEN source END AS author",
        "CASE WHEN doc_id % 19 = 0 THEN 'moderator' END AS distinguished",
        "doc_id % 3 = 0 AS is_submitter",
        "doc_id % 29 = 0 AS stickied",
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "events").selectExpr(
        "concat('p', event_id) AS _post",
        "event_type AS subreddit",
        "concat('/r/', event_type, '/', event_id) AS permalink",
    )
    return lookup(skeleton(spark, sf_dir), "post_id", places, "_post", ["comment_id"])


def more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders: the last comment of ten is collapsed."""
    return (
        skeleton(spark, sf_dir)
        .filter(F.col("comment_id").endswith("9"))
        .select("parent_id", F.array("comment_id").alias("children"))
    )


def inner_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders for comments with replies of their own: the third of ten."""
    ids = skeleton(spark, sf_dir).filter(F.col("comment_id").endswith("2"))
    return ids.select("parent_id", F.array("comment_id").alias("children"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = skeleton(spark, sf_dir).select(F.lit("comment").alias("kind"), "comment_id", "parent_id", "body")
    hidden = more(spark, sf_dir).select(
        F.lit("more").alias("kind"),
        F.lit(None).cast("string").alias("comment_id"),
        "parent_id",
        F.lit(None).cast("string").alias("body"),
    )
    return real.unionByName(hidden)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts per comment, some of which fail; later ones would bring another score."""
    number = F.substring("comment_id", 2, 20).cast("bigint")
    return (
        skeleton(spark, sf_dir)
        .withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
        .select(
            F.col("comment_id").alias("id"),
            "attempt",
            ((number + F.col("attempt")) % 3 != 0).alias("succeeded"),
            F.col("body").alias("story"),
            (F.col("score") + F.col("attempt")).alias("score"),
        )
    )


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents are pairs. Second pairs, with an odd id, have no chosen id, or repeat one and reject an id that
    does not exist."""
    pair = F.expr(
        "filter(array("
        " CASE WHEN doc_id % 2 = 0 THEN named_struct('pair_id', doc_id * 2,"
        "  'chosen_comment_id', concat('c', doc_id), 'rejected_comment_id', concat('c', doc_id + 1)) END,"
        " CASE WHEN doc_id % 22 = 0 THEN named_struct('pair_id', doc_id * 2 + 1,"
        "  'chosen_comment_id', CAST(NULL AS STRING), 'rejected_comment_id', concat('c', doc_id + 2))"
        " WHEN doc_id % 14 = 0 THEN named_struct('pair_id', doc_id * 2 + 1,"
        "  'chosen_comment_id', concat('c', doc_id), 'rejected_comment_id', concat('gone', doc_id)) END), p -> p IS NOT NULL)"
    )
    return table(spark, sf_dir, "documents").select("doc_id").select(F.explode(pair).alias("p")).select("p.*")


def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and poor documents of a language, paired by rank; the poor ones are used over again when they run out."""
    ids = table(spark, sf_dir, "labels").select("doc_id", "quality").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"
    )
    ranked = durable(rank_in_group(ids, ["lang", "quality"], ["doc_id"], "rank"))
    poor = ranked.filter("quality = 0").select(
        F.concat_ws(":", "lang", "rank").alias("_slot"), F.col("doc_id").alias("rejected_id")
    )
    available = ranked.filter("quality = 0").groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_available"))
    # One row per language.
    good = ranked.filter("quality = 1").join(F.broadcast(available), F.col("lang") == F.col("_lang"))
    slots = good.select("doc_id", "lang", F.concat_ws(":", "lang", F.col("rank") % F.col("_available")).alias("slot"))
    pairs = durable(lookup(slots, "slot", poor, "_slot", ["doc_id"], "inner"))
    texts = documents(spark, sf_dir).select("doc_id", "text")
    chosen = texts.select("doc_id", F.col("text").alias("chosen_story"))
    rejected = texts.select(F.col("doc_id").alias("_id"), F.col("text").alias("rejected_story"))
    return lookup(pairs, "rejected_id", rejected, "_id", ["doc_id"], "inner").join(chosen, "doc_id").select(
        F.col("doc_id").alias("pair_id"),
        F.concat_ws(":", F.col("lang"), F.col("doc_id").cast("string")).alias("prompt"),
        "chosen_story",
        "rejected_story",
    )


def rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn: its text and that of the next turn of its role (null behind the last) are the stories, the turn
    before, of any role, is the rationale."""
    turns = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    told = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("story_a"), after.alias("story_b"),
        F.coalesce(before, F.lit("")).alias("said"),
    )
    return told.selectExpr(
        "row_id",
        "story_a",
        "story_b",
        "concat(CASE row_id % 3 WHEN 0 THEN 'Reasoning: ' WHEN 1 THEN 'reasoning: ' ELSE '' END, said) AS rationale",
        "concat(CASE WHEN row_id % 5 = 0 THEN ' ' ELSE '' END,"
        " CASE WHEN length(story_a) >= coalesce(length(story_b), 0) THEN 'A' ELSE 'B' END,"
        " CASE WHEN row_id % 5 = 0 THEN ' ' ELSE '' END) AS preferred",
    )


def noisy_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rationales of which some have a label that is no label."""
    return rationales(spark, sf_dir).withColumn(
        "preferred",
        F.expr("CASE row_id % 7 WHEN 0 THEN 'C' WHEN 1 THEN NULL WHEN 2 THEN lower(preferred) ELSE preferred END"),
    )
