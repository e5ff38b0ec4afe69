"""Links inside groups of candidates, found whole without comparing all pairs of a large group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.llm.components import components
from prefweave.llm.sieve import bitmap_of, sifted
from prefweave.llm.storage import written

# Members of a group that one task compares with the rest of the group.
CHUNK = 2048

Likely = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
Verify = Callable[[DataFrame], DataFrame]


def _pick(node: str = "node") -> Column:
    """A number that orders the members of each group in a way of its own."""
    return F.xxhash64(node).bitwiseXOR(F.col("key"))


def group_centers(members: DataFrame) -> DataFrame:
    """(key, center) of every group of more than one member: the hash of the node of one member, another one in each group
    by chance. Rows stay narrow, and counting combines on the map side."""
    counted = members.groupBy("key").agg(F.min(_pick()).alias("_least"), F.count("*").alias("_size"))
    return written(counted.filter("_size > 1").select("key", F.col("_least").bitwiseXOR(F.col("key")).alias("center")))


def star_pairs(members: DataFrame, centers: DataFrame) -> DataFrame:
    """(node, center): every member of a group against its center. A group of any size is only joined to one row."""
    return members.join(centers, "key").select("node", "center").filter(F.xxhash64("node") != F.col("center")).distinct()


def _both(pairs: DataFrame, nodes: DataFrame, likely: Likely) -> DataFrame:
    """Pairs (a, b) that may be linked by their payloads in `nodes`."""
    left = nodes.select(*[F.col(c).alias(f"_l_{c}") for c in nodes.columns])
    right = nodes.select(*[F.col(c).alias(f"_r_{c}") for c in nodes.columns])
    found = pairs.join(left, F.col("node") == F.col("_l_node")).join(right, F.col("center") == F.xxhash64("_r_node"))
    kept = found.filter(likely(lambda c: F.col(f"_l_{c}"), lambda c: F.col(f"_r_{c}")))
    return kept.select(F.greatest("_l_node", "_r_node").alias("a"), F.least("_l_node", "_r_node").alias("b")).distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of groups of more than two whose members are not all connected yet: key, node, label, `_large` for members of
    the largest part of their group, and the number of `_chunks` that the group is cut into."""
    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    parts = labelled.groupBy("key", "label").count()
    groups = parts.groupBy("key").agg(
        F.sum("count").alias("_size"), F.count("*").alias("_parts"), F.max(F.struct("count", "label"))["label"].alias("_largest")
    )
    open_ = written(groups.filter((F.col("_parts") > 1) & (F.col("_size") > 2)))
    return written(
        sifted(labelled, F.col("key"), bitmap_of(open_, "key")).join(open_, "key").select(
            "key", "node", "label", (F.col("label") == F.col("_largest")).alias("_large"),
            F.ceil(F.col("_size") / CHUNK).cast("int").alias("_chunks"),
        )
    )


def remaining_pairs(rows: DataFrame, nodes: DataFrame, likely: Likely, tested: DataFrame) -> DataFrame:
    """Pairs of open groups between parts: members of the smaller parts against all members of other parts.

    Members of the largest part are connected already and need no comparison among each other. Large groups are cut into
    chunks of CHUNK members, which the members of the smaller parts visit one by one; the join keeps likely pairs only, and
    a pair that stands together in many groups only in the group of its least common key.
    """
    full = rows.join(nodes, "node")
    payload = ["node", *[c for c in nodes.columns if c != "node"]]
    home = full.select(
        F.col("key").alias("_key"), F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int").alias("_chunk"),
        F.col("label").alias("_r_label"), "_large", *[F.col(c).alias(f"_r_{c}") for c in payload],
    )
    visits = full.filter(~F.col("_large")).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_visit"),
        F.col("label").alias("_l_label"), *[F.col(c).alias(f"_l_{c}") for c in payload],
    )
    met = (
        (F.col("key") == F.col("_key")) & (F.col("_visit") == F.col("_chunk")) & (F.col("_l_label") != F.col("_r_label"))
        & (F.col("_large") | (F.col("_l_node") > F.col("_r_node")))
        & likely(lambda c: F.col(f"_l_{c}"), lambda c: F.col(f"_r_{c}"))
        & (F.array_min(F.array_intersect("_l_keys", "_r_keys")) == F.col("key"))
    )
    pairs = visits.join(home, met).select(
        F.greatest("_l_node", "_r_node").alias("a"), F.least("_l_node", "_r_node").alias("b")
    )
    return pairs.distinct().join(tested, ["a", "b"], "left_anti")


def linked(
    nodes: DataFrame, likely: Likely, verify: Verify, sharpen: Callable[[DataFrame], DataFrame] | None = None,
    surely: Likely | None = None, sparse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(labels, links): the connected groups of all true links between nodes that share a key, and the links found.

    `nodes` has one row per `node` with its `keys`, an array of distinct numbers, and what `likely` reads, which may only
    reject pairs that are no links. `verify` keeps the pairs (a, b) that are links. First every node is compared with one
    node of each of its groups; then all pairs are, whose ends are not connected by that. So no link between parts is lost,
    and groups of near copies cost as many comparisons as they have members. For the second step `sharpen` may replace the
    nodes that are left (one column) by rows of (node, keys, ...) that `surely` reads, to reject more. Where few
    nodes share a key (`sparse`), they are set apart once, so that the others do not move.
    """
    members = nodes.select(F.explode("keys").alias("key"), "node")
    centers = group_centers(members)
    # Most groups have one member: a bitmap of the others lets few rows through to what follows.
    members = sifted(members, F.col("key"), bitmap_of(centers, "key"))
    # The bitmap lets some through that are alone in their group.
    members = written(members.join(centers, "key", "left_semi") if sparse else members)
    if sparse:
        nodes = written(sifted(nodes, F.col("node"), bitmap_of(members, "node")))
    first = written(_both(star_pairs(members, centers), nodes.drop("keys"), likely))
    links = written(verify(first))
    labels = written(components(links))
    rows = open_members(members, labels)
    left = rows.select("node").distinct()
    known = nodes.join(left, "node", "left_semi") if sharpen is None else written(sharpen(left))
    second = written(remaining_pairs(rows, known, surely or likely, first))
    more = written(verify(second)) if not second.isEmpty() else second
    if more.isEmpty():
        return labels, links
    return written(_merged(labels, more)), links.union(more)


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The labels after further links: only the labels that these join are connected anew."""
    ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    every = labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    left = every.select(F.col("node").alias("a"), F.col("label").alias("_a"))
    right = every.select(F.col("node").alias("b"), F.col("label").alias("_b"))
    joined = more.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    moved = components(joined).select(F.col("node").alias("_old"), F.col("label").alias("_new"))
    told = every.join(moved, F.col("label") == F.col("_old"), "left")
    return told.select("node", F.coalesce("_new", "label").alias("label"))
