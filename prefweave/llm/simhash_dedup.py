"""SimHash near-duplicates: fingerprints compared exactly, tile by tile, within groups that no link can leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.llm.columns import text_function
from prefweave.llm.components import components
from prefweave.llm.storage import written

SHINGLE = 4
SEED = 42
# Fingerprints that differ in so many bits at most are linked.
RADIUS = 4
# Fingerprints of one tile: two tiles are compared by one exclusive-or of all with all.
TILE = 512
# Groups of more fingerprints than this are split by further bits, or compared in chunks.
GROUP = 1 << 15


def fingerprint(text: str) -> int:
    """SimHash of the word shingles of a text, repeats included: a bit is set where it is in over half of the hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes).tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    ones, total = np.zeros(64, np.int64), len(ends)
    for at in range(0, total, 1 << 16):
        some = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begins[at : at + (1 << 16)], ends[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(some, np.uint64).view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > total).astype(np.uint8)).view(np.uint64)[0])


def _signer():
    return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]


def fingerprints(text: Column) -> Column:
    """The SimHash of each text as a bigint; 0 for texts without words, null ones included."""
    return text_function("f bigint", {"f": pa.int64()}, _signer)(text)["f"]


def _blocks(fixed: int) -> list[int]:
    """The bits that `fixed` leaves, dealt to RADIUS + 1 blocks of neighbouring bits, each together with the fixed ones."""
    free = [b for b in range(64) if not fixed >> b & 1]
    parts = np.array_split(np.array(free, np.int64), RADIUS + 1)
    return [fixed | sum(1 << int(b) for b in part) for part in parts if len(part)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _members(rows: DataFrame, masks: Column) -> DataFrame:
    """(mask, key, f): a row for each of the `masks`; those with one key share all bits of their mask."""
    spread = rows.select("f", F.explode(masks).alias("mask"))
    return spread.select("mask", F.col("f").bitwiseAND(F.col("mask")).alias("key"), "f")


def _mask_array(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)) for m in masks])


def _parted(level: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups of `limit` members at most, and the other rows, with the `size` of their group."""
    large = written(level.groupBy("mask", "key").agg(F.count("*").alias("size")).filter(F.col("size") > limit))
    return level.join(large, ["mask", "key"], "left_anti"), level.join(large, ["mask", "key"])


def pigeonhole_groups(prints: DataFrame, limit: int = GROUP) -> DataFrame:
    """(mask, key, part, f) of different fingerprints `f`: whatever is linked shares a group, and no group is much larger
    than `limit`, whatever the bits.

    Of RADIUS + 1 blocks of bits one is the same in two fingerprints that differ in RADIUS bits. Members of a group that is too
    large are grouped once more, by a block of the bits that they need not share, which loses no link either; even bits leave
    some n / 2^23 members then. What is too large still is crowded around few fingerprints: such a group is cut into
    chunks, and every two of its chunks make a group.
    """
    masks = _blocks(0)
    none = F.lit(0).cast("bigint").alias("part")
    small, open_ = _parted(_members(prints, _mask_array(masks)), limit)
    groups = small.select("mask", "key", none, "f")
    open_ = written(open_)
    if open_.isEmpty():
        return groups
    finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), _mask_array(_blocks(m)))])
    small, open_ = _parted(written(_members(open_, F.element_at(finer, F.col("mask")))), limit)
    groups = groups.unionByName(small.select("mask", "key", none, "f"))
    chunks = F.ceil(F.col("size") * 4 / limit).cast("bigint")
    own = open_.withColumn("_chunks", chunks).withColumn("_own", F.pmod(F.xxhash64("f"), F.col("_chunks")))
    met = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)))
    part = F.least("_own", "_other") * F.col("_chunks") + F.greatest("_own", "_other") + 1
    return groups.unionByName(met.select("mask", "key", part.alias("part"), "f"))


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member each member is joined to, after the links between `a` and `b`."""
    while True:
        left, right = parent[a], parent[b]
        open_ = left != right
        if not open_.any():
            return parent
        a, b, left, right = a[open_], b[open_], left[open_], right[open_]
        np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


def tiled_links(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links within RADIUS bits join: each fingerprint with the first of its connected group.

    Fingerprints are sorted by population count and cut into tiles. Counts that differ by more than RADIUS rule a link out,
    so such pairs of tiles are skipped; every other pair is compared whole, by exclusive-or and bit counts.
    """
    counts = np.bitwise_count(values)
    order = np.argsort(counts, kind="stable")
    values, counts = values[order], counts[order].astype(np.int64)
    parent = np.arange(len(values))
    for i in range(0, len(values), TILE):
        rows = values[i : i + TILE]
        most = counts[min(i + TILE, len(values)) - 1] + RADIUS
        for j in range(i, len(values), TILE):
            if counts[j] > most:
                break
            a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ values[None, j : j + TILE]) <= RADIUS)
            a, b = a + i, b + j
            if i == j:
                a, b = a[a < b], b[a < b]
            if len(a):
                parent = _united(parent, a, b)
    own = np.flatnonzero(parent != np.arange(len(values)))
    return values[own], values[parent[own]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every group; rows come sorted by group, and a group may go on in the next batch."""
    kept = [np.zeros(0, np.int64)] * 4

    def links(*columns: np.ndarray) -> pa.RecordBatch:
        *group, f = columns
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in group], axis=0)) + 1
        edges = np.concatenate([[0], edges, [len(f)]])
        some = [tiled_links(f[a:b].view(np.uint64)) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1]
        sides = [np.concatenate([s[i] for s in some]).view(np.int64) if some else np.zeros(0, np.int64) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(s) for s in sides], ["a", "b"])

    for batch in batches:
        columns = [np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate(kept)]
        if not len(columns[0]):
            continue
        inside = np.any([c != c[-1] for c in columns[:-1]], axis=0)
        end = int(np.flatnonzero(inside)[-1]) + 1 if inside.any() else 0
        if end:
            yield links(*[c[:end] for c in columns])
        kept = [c[end:] for c in columns]
    yield links(*kept)


def fingerprint_links(prints: DataFrame, limit: int = GROUP) -> DataFrame:
    """(a, b): links between different fingerprints `f` that connect whatever links within RADIUS bits connect."""
    groups = pigeonhole_groups(prints, limit)
    # Work grows faster than bytes here, so small partitions are not put together.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(parts, "mask", "key", "part").sortWithinPartitions("mask", "key", "part")
    return dealt.mapInArrow(_compare, "a bigint, b bigint")


def simhash_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = GROUP) -> DataFrame:
    """Every row of `docs` with its SimHash `fingerprint` (bigint) and `component_id`, the least id reachable.

    Fingerprints link at RADIUS differing bits or fewer. Null and empty texts have fingerprint 0 and are linked like any
    other. Null ids count only where a component has no other; such a component has a null `component_id`. Rows with one id
    share nothing but that id. An empty table gives no rows. Ids may be of any orderable type.

    Rows with one fingerprint fall together first, by an aggregation that combines on the map side, so copies cost nothing
    more, however many there are. Different fingerprints meet in groups of bounded size, whatever their bits.
    """
    rows = written(docs.select(F.col(id_column).alias("_id"), fingerprints(F.col(text_column)).alias("f")))
    prints = written(rows.groupBy("f").agg(F.min("_id").alias("_least")))
    labels = components(fingerprint_links(prints.select("f"), limit))
    labelled = written(labels.join(prints, F.col("node") == F.col("f")).select("f", "label", "_least"))
    least = labelled.groupBy("label").agg(F.min("_least").alias("_component"))
    joined = labelled.join(least, "label").select(F.col("f").alias("_f"), "_component")
    told = written(
        prints.join(joined, F.col("f") == F.col("_f"), "left")
        .select(F.col("f").alias("_f"), F.when(F.col("_f").isNull(), F.col("_least")).otherwise(F.col("_component")).alias("_component"))
    )
    placed = rows.join(told, F.col("f") == F.col("_f"))
    return placed.select(F.col("_id").alias(id_column), F.col("f").alias("fingerprint"), F.col("_component").alias("component_id"))
