"""Comment trees: depth and breadth-first order, replies, placeholders, comments nested in their post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave import fixed_values as V
from prefweave.durable import durable
from prefweave.functions.text import is_top_level
from prefweave.operators.forum import comment_record, post_record, reply_record
from prefweave.operators.skew import HOT_ROWS, key_load, lookup, rank_in_group, running_max
from prefweave.operators.tours import HIDDEN, breadth_first, numbered_tree

# Comments per row when they are nested in their post; a larger post takes several rows.
COMMENTS_PER_ROW = 10_000


def _ancestry(comments: DataFrame, hot_rows: int, paths: bool) -> DataFrame:
    """comment_id, post_id, depth, missing, rooted, and `chain` where `paths` are wanted.

    Each round lets every open comment jump over as many ancestors as the one it has come to has passed, so a tree of depth d
    takes log2(d) joins, whatever its width, on ids and a few numbers. `rooted` says that the jumps ended at the post;
    otherwise an ancestor is `missing` from the table, or the parents run in a circle.
    """
    parent = F.col("parent_id")
    own = [F.lit(0).cast("bigint").alias("depth")]
    if paths:
        own.append(F.array(F.struct((-F.col("score")).alias("rank"), F.col("comment_id").alias("id"))).alias("chain"))
    nodes = comments.select(
        "comment_id",
        "post_id",
        F.when(parent.startswith(V.COMMENT_PREFIX), F.substring(parent, len(V.COMMENT_PREFIX) + 1, 1 << 30)).alias("up"),
        is_top_level(parent).alias("top"),
        *own,
    )
    known = comments.select(F.col("comment_id").alias("_known_id"), F.lit(True).alias("_known"))
    nodes = lookup(nodes, "up", known, "_known_id", ["comment_id"], hot_rows=hot_rows)
    carried = ["depth", "chain"] if paths else ["depth"]
    nodes = durable(
        nodes.select(
            "comment_id",
            "post_id",
            F.when(F.col("_known"), F.col("up")).alias("up"),
            F.when(F.col("_known").isNull(), F.col("up")).alias("missing"),
            F.coalesce(F.col("top"), F.lit(False)).alias("rooted"),
            *carried,
        )
    )
    passed = {"depth": F.col("depth") + F.col("_depth") + 1, "chain": F.concat("_chain", "chain") if paths else None}
    closed, open_ = nodes.filter(F.col("up").isNull()), nodes.filter(F.col("up").isNotNull())
    left = None
    while True:
        load = key_load(open_.select("up"))
        if load.rows in (0, left):
            break
        above = closed.unionByName(open_).select(
            F.col("comment_id").alias("_above"),
            *[F.col(c).alias(f"_{c}") for c in ("up", "missing", "rooted", *carried)],
        )
        extended = lookup(open_, "up", above, "_above", ["comment_id"], "inner", hot_rows, load).select(
            "comment_id",
            "post_id",
            *[F.col(f"_{c}").alias(c) for c in ("up", "missing", "rooted")],
            *[passed[c].alias(c) for c in carried],
        )
        # Only what changed is written; comments closed in earlier rounds stay where they are.
        extended = durable(extended)
        closed = closed.unionByName(extended.filter(F.col("up").isNull()))
        open_, left = extended.filter(F.col("up").isNotNull()), load.rows
    return closed.unionByName(open_).withColumn("rooted", F.col("rooted") & F.col("up").isNull())


def comment_tree(comments: DataFrame, max_depth: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """C7. Every comment with its `depth` (0 below the post): comment_id, post_id, depth, missing.

    A comment whose ancestors are not all there keeps its row with a null depth, whatever `max_depth` is; that keeps the
    levels up to that depth. `comment_positions` has the breadth-first order, `comment_paths` the way down to each comment.
    """
    found = _ancestry(comments, hot_rows, paths=False)
    tree = found.select("comment_id", "post_id", F.when(F.col("rooted"), F.col("depth")).cast("int").alias("depth"), "missing")
    return tree if max_depth is None else tree.filter(F.col("depth").isNull() | (F.col("depth") <= max_depth))


def comment_paths(comments: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """C7 with the `chain` of (rank, id) from the topmost known ancestor to each comment; an output format.

    A chain is as long as its comment is deep. Nothing else here is made from chains.
    """
    found = _ancestry(comments, hot_rows, paths=True)
    return found.select("comment_id", "post_id", F.when(F.col("rooted"), F.col("depth")).cast("int").alias("depth"), "chain", "missing")


def placeholder_children(more: DataFrame) -> DataFrame:
    """The distinct comment ids that placeholders stand for."""
    return more.select(F.explode("children").alias("comment_id")).distinct()


def expand_more(more: DataFrame, comments: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """C6. The comments behind all placeholders, added to the `loaded` ones; each comment once.

    Ids decide first: text moves only for the comments that are kept, and nothing is deduplicated on text.
    """
    children = placeholder_children(more)
    expanded = comments.join(children, "comment_id", "left_semi")
    if loaded is None:
        return expanded
    behind = children.join(comments.select("comment_id"), "comment_id", "left_semi")
    return loaded.join(behind, "comment_id", "left_anti").unionByName(expanded)


def partial_tree(comments: DataFrame, more: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """C5. The numbered tree without the comments that placeholders stand for, and without what hangs below these.

    A hidden comment is cut off together with all below it, so its whole section goes.
    """
    return numbered_tree(comments, placeholder_children(more), hot_rows).filter(F.col("kind") != HIDDEN)


def loaded_only(comments: DataFrame, more: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """C5. The comments of `partial_tree`."""
    return comments.join(partial_tree(comments, more, hot_rows).select("comment_id"), "comment_id", "left_semi")


def comment_positions(comments: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """comment_id, post_id, depth and breadth-first `position` of every comment."""
    return breadth_first(numbered_tree(comments, hot_rows=hot_rows))


def chosen_positions(comments: DataFrame, more: DataFrame | None, complete: bool, hot_rows: int) -> DataFrame:
    if complete:
        return comment_positions(comments, hot_rows)
    if more is None:
        raise ValueError("the partial mode needs the placeholders")
    return breadth_first(partial_tree(comments, more, hot_rows))


def comments_in_order(
    comments: DataFrame, more: DataFrame | None = None, complete: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """C4, flat: the comment records with post_id and their breadth-first `position` in the post."""
    return _placed(comments, chosen_positions(comments, more, complete, hot_rows))


def _placed(comments: DataFrame, positions: DataFrame) -> DataFrame:
    return comment_record(comments).join(positions.select("comment_id", "post_id", "position"), "comment_id")


def with_comments(
    posts: DataFrame,
    comments: DataFrame,
    more: DataFrame | None = None,
    complete: bool = True,
    per_row: int = COMMENTS_PER_ROW,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """C4. Post records with their comments as an array in breadth-first order; an output format.

    A post of any size stays whole: every `per_row` comments take a row of their own, numbered by `part`, so that no
    array has to hold an unbounded group. A post up to that size is one row with part 0, one without comments has an
    empty array. With `complete=False`, comments behind placeholders are left out. Post and comments meet on post and
    part, so that the parts of a large post do not meet in one task either.
    """
    return _nested(posts, comments, chosen_positions(comments, more, complete, hot_rows), per_row)


def _nested(posts: DataFrame, comments: DataFrame, positions: DataFrame, per_row: int) -> DataFrame:
    """Posts with the comments that have a position; the text of a comment moves by its own id."""
    positions = durable(positions)
    entry = F.struct("position", *V.COMMENT_FIELDS)
    nested = (
        _placed(comments, positions)
        .groupBy(F.col("post_id").alias("_post"), F.floor(F.col("position") / per_row).alias("_part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("comments"))
        .withColumn("comments", F.transform("comments", lambda c: c.dropFields("position")))
    )
    sizes = positions.groupBy(F.col("post_id").alias("_sized")).agg(F.count("*").alias("_size"))
    last_part = F.floor((F.coalesce(F.col("_size"), F.lit(1)) - 1) / per_row)
    parts = (
        post_record(posts)
        .join(sizes, F.col("post_id") == F.col("_sized"), "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last_part)))
        .drop("_sized", "_size")
    )
    return (
        parts.join(nested, (F.col("post_id") == F.col("_post")) & (F.col("part") == F.col("_part")), "left")
        .withColumn("comments", F.coalesce("comments", F.array()))
        .drop("_post", "_part")
    )


def posts_with_comments_by_id(
    posts: DataFrame,
    comments: DataFrame,
    ids: DataFrame,
    more: DataFrame | None = None,
    complete: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """C3 with C4: the wanted posts (column post_id of `ids`) with their comments; an unknown id is a null row.

    Trees are built for the wanted posts only, which are found on ids alone: a post with very many comments is no hot key.
    """
    wanted = durable(ids.select("post_id").distinct())
    skeleton = _of_posts(comments, wanted, hot_rows)
    positions = chosen_positions(skeleton, more, complete, hot_rows)
    found = _nested(posts.join(wanted, "post_id", "left_semi"), comments, positions, COMMENTS_PER_ROW)
    unknown = wanted.join(posts.select("post_id"), "post_id", "left_anti")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name != "post_id"]
    return found.unionByName(unknown.select("post_id", *empty))


def _of_posts(comments: DataFrame, posts: DataFrame, hot_rows: int) -> DataFrame:
    """The skeletons (comment_id, post_id, parent_id, score) of the comments of `posts` (different post_id)."""
    skeleton = comments.select("comment_id", "post_id", "parent_id", "score")
    return lookup(skeleton, "post_id", posts.select(F.col("post_id").alias("_wanted")), "_wanted", ["comment_id"], "inner", hot_rows)


def _child_starts(placed: DataFrame) -> DataFrame:
    """(section, place, start) for every comment: the place at which the children of it and of all later ones begin.

    In breadth-first order the children of neighbours are neighbours, too, and begin where those of all earlier comments end:
    behind the tops of the section, or behind the last child so far.
    """
    ends = placed.filter("level > 0").groupBy(F.col("up").alias("_parent")).agg((F.max("place") + 1).alias("end"))
    points = placed.select("comment_id", "section", "place").join(ends, F.col("comment_id") == F.col("_parent"), "left")
    tops = placed.filter("level = 0").groupBy("section").agg(F.count("*").alias("end"))
    points = points.select("section", "place", "end").unionByName(tops.select("section", F.lit(-1).cast("bigint").alias("place"), "end"))
    # Sections follow one another, each behind its own tops, so that no earlier one reaches into it.
    points = points.withColumn("_reach", F.when(F.col("end").isNotNull(), F.struct("section", "end")))
    return running_max(points, ["section", "place"], "_reach", "_before").filter("place >= 0").select(
        F.col("section").alias("_section"), F.col("place").alias("_place"), F.col("_before.end").alias("_start")
    )


def replies(
    comments: DataFrame,
    ids: DataFrame,
    reply_limit: int = V.REPLY_LIMIT,
    hot_rows: int = HOT_ROWS,
    more: DataFrame | None = None,
) -> DataFrame:
    """C9. The first `reply_limit` descendants of each wanted comment (column comment_id of `ids`), breadth first.

    One row per reply: the record with its depth below the wanted comment (1 for a direct reply), `root_id` for the
    wanted comment and `rank` from 1. Only the posts of wanted comments are looked at. With `more`, comments that placeholders
    stand for are left out with all below them, and take no place among the first; a hidden comment that is wanted itself
    has the replies that no other placeholder below it hides. Parents that run in a circle have no replies.

    In breadth-first order the descendants of a comment are one range of places per level. So each wanted comment goes down
    level by level, as two numbers, until it has enough replies: as many joins on unique places as levels are needed, on no
    more rows than comments are wanted, whatever the size and the depth of the tree.
    """
    seeds = durable(ids.select("comment_id").distinct())
    seed_posts = comments.select("comment_id", "post_id").join(seeds, "comment_id", "left_semi").select("post_id").distinct()
    skeleton = durable(_of_posts(comments, durable(seed_posts), hot_rows))
    numbered = numbered_tree(skeleton, None if more is None else placeholder_children(more), hot_rows)
    parents = skeleton.select(
        F.col("comment_id").alias("_id"), F.substring("parent_id", len(V.COMMENT_PREFIX) + 1, 1 << 30).alias("up")
    )
    trees = numbered.filter("section IS NOT NULL").join(parents, F.col("comment_id") == F.col("_id")).select(
        "comment_id", "section", "level", "entry", "up"
    )
    placed = durable(rank_in_group(trees, ["section"], ["level", "entry"], "place"))
    starts = durable(_child_starts(placed))
    first = starts.withColumnsRenamed({"_section": "_s1", "_place": "_p1", "_start": "_a"})
    behind = starts.withColumnsRenamed({"_section": "_s2", "_place": "_p2", "_start": "_b"})
    front = placed.join(seeds, "comment_id", "left_semi").select(
        F.col("comment_id").alias("root_id"), "section", F.col("place").alias("a"), (F.col("place") + 1).alias("b"),
        F.lit(0).cast("bigint").alias("taken"),
    )
    found = None
    for depth in range(1, reply_limit + 1):
        below = front.join(first, (F.col("section") == F.col("_s1")) & (F.col("a") == F.col("_p1"))).join(
            behind, (F.col("section") == F.col("_s2")) & (F.col("b") == F.col("_p2")), "left"
        )
        # Behind the last comment of a section there is nothing: what begins there ends there, too.
        level = below.select("root_id", "section", F.col("_a").alias("a"), F.coalesce("_b", "b").alias("b"), "taken").filter("a < b")
        level = durable(level.withColumn("depth", F.lit(depth)))
        found = level if found is None else found.unionByName(level)
        front = level.withColumn("taken", F.col("taken") + F.col("b") - F.col("a")).filter(F.col("taken") < reply_limit).drop("depth")
        if front.isEmpty():
            break
    last = F.least(F.col("b") - 1, F.col("a") + (reply_limit - 1) - F.col("taken"))
    ranked = found.select("root_id", "section", "depth", "a", "taken", F.explode(F.sequence("a", last)).alias("_place")).select(
        "root_id", F.col("section").alias("_section"), "depth", "_place", (F.col("taken") + F.col("_place") - F.col("a") + 1).alias("rank")
    )
    named = placed.select("section", "place", "comment_id")
    listed = ranked.join(named, (F.col("_section") == F.col("section")) & (F.col("_place") == F.col("place"))).select(
        "root_id", "rank", F.col("depth").cast("int").alias("depth"), "comment_id"
    )
    text = comments.select("comment_id", "body", "score", "created_utc", "author", "parent_id")
    joined = lookup(
        listed, "comment_id", text.withColumnRenamed("comment_id", "_id"), "_id", ["root_id"], "inner", hot_rows
    )
    return reply_record(joined, "root_id", "rank")


def with_replies(records: DataFrame, reply_rows: DataFrame) -> DataFrame:
    """Comment records with their replies as an array; at most the reply limit per comment, so it is bounded."""
    entry = F.struct("rank", *V.REPLY_FIELDS)
    nested = reply_rows.groupBy("root_id").agg(F.array_sort(F.collect_list(entry)).alias("replies"))
    nested = nested.withColumn("replies", F.transform("replies", lambda r: r.dropFields("rank")))
    return (
        records.join(nested, F.col("comment_id") == F.col("root_id"), "left")
        .withColumn("replies", F.coalesce("replies", F.array()))
        .drop("root_id")
    )
