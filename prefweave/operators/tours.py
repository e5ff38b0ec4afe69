"""Comment trees as numbers: Euler tours, ranked by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave import fixed_values as V
from prefweave.durable import durable
from prefweave.functions.text import is_top_level
from prefweave.operators.skew import HOT_ROWS, lookup, rank_in_group, rank_rows

# What a tree hangs from: its post, an ancestor that is missing, a placeholder, or nothing, as the parents run in a circle.
ROOTED, ORPHANED, HIDDEN, CIRCULAR = range(4)


def _siblings(comments: DataFrame, hidden: DataFrame | None, hot_rows: int) -> DataFrame:
    """comment_id, post_id, rank, missing, and the `key` that siblings share: k:… for a root of that kind, else c:parent."""
    parent = F.col("parent_id")
    nodes = comments.select(
        "comment_id",
        "post_id",
        (-F.col("score")).alias("rank"),
        F.when(parent.startswith(V.COMMENT_PREFIX), F.substring(parent, len(V.COMMENT_PREFIX) + 1, 1 << 30)).alias("up"),
        F.coalesce(is_top_level(parent), F.lit(False)).alias("top"),
    )
    known = comments.select(F.col("comment_id").alias("_known_id"), F.lit(True).alias("_known"))
    nodes = lookup(nodes, "up", known, "_known_id", ["comment_id"], hot_rows=hot_rows)
    nodes = nodes.withColumn("missing", F.when(F.col("_known").isNull(), F.col("up")))
    cut = F.lit(False)
    if hidden is not None:
        ids = hidden.select(F.col("comment_id").alias("_id")).distinct()
        own, gone = (ids.select(F.col("_id").alias(f"_{c}")) for c in ("own", "gone"))
        nodes = nodes.join(own, F.col("comment_id") == F.col("_own"), "left")
        nodes = lookup(nodes, "missing", gone.withColumn("_cut", F.lit(True)), "_gone", ["comment_id"], hot_rows=hot_rows)
        cut = F.col("_own").isNotNull() | F.coalesce("_cut", F.lit(False))
    key = (
        F.when(cut, F.concat(F.lit(f"{HIDDEN}:"), "comment_id"))
        .when(F.col("top"), F.concat_ws(":", F.lit(ROOTED), "post_id"))
        .when(F.col("_known"), F.concat(F.lit("c:"), "up"))
        .otherwise(F.concat_ws(":", F.lit(ORPHANED), "post_id"))
    )
    return nodes.select("comment_id", "post_id", "rank", "missing", key.alias("key"))


def _ranked(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a list of elements (e, next, steps, net, end): the closed ones, with the sums up to the end of their list, and those
    of lists without an end.

    Every round lets each open element jump over the part that the one it points to has covered, which doubles what it covers
    itself. No two elements point to the same one, so no key is hot, and each holds five numbers, however long its list.
    """
    elements = durable(elements)
    closed, open_ = elements.filter("next IS NULL"), elements.filter("next IS NOT NULL")
    left = None
    while True:
        count = open_.count()
        if count in (0, left):
            return closed, open_
        ahead = closed.unionByName(open_).select(*[F.col(c).alias(f"_{c}") for c in ("e", "next", "steps", "net", "end")])
        moved = durable(
            open_.join(ahead, F.col("next") == F.col("_e")).select(
                "e", F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps"),
                (F.col("net") + F.col("_net")).alias("net"), F.col("_end").alias("end"),
            )
        )
        # Only what changed is written; elements closed in earlier rounds stay where they are.
        closed, open_, left = closed.unionByName(moved.filter("next IS NULL")), moved.filter("next IS NOT NULL"), count


def numbered_tree(comments: DataFrame, hidden: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every comment with its place in its tree, in a few numbers: comment_id, post_id, kind, section, level, entry, exit, missing.

    The comments of a post that hang from the post are a section (kind ROOTED), those whose topmost known ancestor misses its
    parent another (ORPHANED; `missing` is that parent, for the topmost). A comment of `hidden` (comment_id), or one whose
    missing parent is hidden, is cut off and heads a section of its own (HIDDEN). Parents that run in a circle have no section
    (CIRCULAR). `level` counts from 0 below what the section hangs from. A comment lies below another one if its entry and exit
    lie between the other's. Within a section (level, entry) is breadth-first order: siblings by score, highest first, then id.

    A tour of a section enters and leaves every comment once: after entering it goes on to the first child or leaves again, after
    leaving to the next sibling or up. Siblings are numbered in a row, so that the tour is known from the first and last
    number of every group of siblings, and a parent meets its children's group, not its children. The tour is then ranked by
    pointer doubling: a tree of n comments takes log2(2n) joins on unique keys and space for 2n elements, however deep it is.
    """
    numbered = durable(rank_rows(_siblings(comments, hidden, hot_rows), ["key", "rank", "comment_id"], "n"))
    groups = durable(numbered.groupBy("key").agg(F.min("n").alias("first"), F.max("n").alias("last")))
    below = F.col("key").startswith("c:")
    children = groups.filter(below).select(F.substring("key", 3, 1 << 30).alias("_parent"), "first", "last")
    nodes = durable(
        numbered.select("comment_id", "n").join(children, F.col("comment_id") == F.col("_parent"), "left").select("n", "first", "last")
    )
    # The last of every group of siblings goes up to the parent, or to the end of its section, named by its number and kind.
    ends = nodes.filter("last IS NOT NULL").select(F.col("last").alias("_at"), (F.col("n") * 2 + 1).alias("_up"), F.lit(None).cast("bigint").alias("_end"))
    kind = F.substring("key", 1, 1).cast("bigint")
    ends = ends.unionByName(
        groups.filter(~below).select(F.col("last").alias("_at"), F.lit(None).cast("bigint").alias("_up"), (F.col("last") * 4 + kind).alias("_end"))
    )
    after = F.when(F.col("_at").isNull(), F.col("n") * 2 + 2).otherwise(F.col("_up"))
    step = lambda e, to, net, end: F.struct(
        e.alias("e"), to.alias("next"), F.lit(1).cast("bigint").alias("steps"), F.lit(net).cast("bigint").alias("net"), end.alias("end")
    )
    enter = step(F.col("n") * 2, F.coalesce(F.col("first") * 2, F.col("n") * 2 + 1), -1, F.lit(None).cast("bigint"))
    leave = step(F.col("n") * 2 + 1, after, 1, F.col("_end"))
    tour = nodes.join(ends, F.col("n") == F.col("_at"), "left").select(F.explode(F.array(enter, leave)).alias("s")).select("s.*")
    closed, _ = _ranked(tour)
    entering = F.col("e") % 2 == 0
    places = closed.groupBy(F.floor(F.col("e") / 2).cast("bigint").alias("_n")).agg(
        F.max(F.when(entering, -F.col("steps"))).alias("entry"), F.max(F.when(~entering, -F.col("steps"))).alias("exit"),
        F.max(F.when(entering, F.col("net"))).alias("level"), F.max("end").alias("section"),
    )
    found = numbered.join(places, F.col("n") == F.col("_n"), "left")
    of_kind = F.coalesce(F.col("section") % 4, F.lit(CIRCULAR)).cast("int")
    return found.select("comment_id", "post_id", of_kind.alias("kind"), "section", "level", "entry", "exit", "missing")


def breadth_first(numbered: DataFrame) -> DataFrame:
    """comment_id, post_id, depth and breadth-first `position` in the post, from 0, of a numbered tree.

    Comments that do not hang from the post have no depth and come last: orphaned trees, level by level, then circles by id.
    """
    ordered = numbered.select(
        "comment_id", "post_id", F.when(F.col("kind") == ROOTED, F.col("level")).cast("int").alias("depth"),
        "kind", F.coalesce("level", F.lit(0)).alias("_level"), F.coalesce("entry", F.lit(0)).alias("_entry"),
    )
    ranked = rank_in_group(ordered, ["post_id"], ["kind", "_level", "_entry", "comment_id"], "position")
    return ranked.select("comment_id", "post_id", "depth", "position")
