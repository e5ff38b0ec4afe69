"""Fuzzy line dedup: SimHash of normalised lines, joined on blocks of bits, verified by edit similarity."""

from __future__ import annotations

import collections.abc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.llm.columns import release_memory, slices, text_function
from prefweave.llm.linking import linked
from prefweave.llm.sieve import bitmap_of, marked, sifted
from prefweave.llm.storage import written
from prefweave.llm.words import ALPHANUMERIC, joined, mixed, word_hashes, word_places

# A SimHash has BLOCKS blocks of BLOCK_BITS bits. In each block only some of the different words of a line vote, by a hash of the word,
# so that a changed word leaves most blocks as they were: the least share of VOTING (of 256) by which LEAST_VOTERS vote at all. Lines
# meet that have a block in common: always when the words that differ vote in less than all blocks (pigeonhole), else by chance.
# A block is as wide as two fit into a signed column: lines that differ in all their words share one with a chance of 1 in 2^31.
BLOCKS = 6
BLOCK_BITS = 31
VOTING = (48, 96, 192, 256)
LEAST_VOTERS = 3
# Lines that meet by chance differ in some 77 of the other 155 bits; lines of edit similarity 0.9 mostly in fewer than this.
MOST_BITS = 64
# Lines are alike when edits, to the longer one's length, leave this share.
SIMILARITY = (90, 100)
# Characters of a line that is long.
LONG_LINE = 4096
# Lengths within that share of each other fall into the same class of this ratio, or a class that both stand in.
CLASS_RATIO = 2.0

_ALL = np.arange(256)
# Letters in lower case, every digit as 0, everything else as a blank.
FOLD = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 0x20, _ALL)
FOLD = np.where((_ALL >= 0x30) & (_ALL <= 0x39), 0x30, FOLD)
FOLD = np.where(ALPHANUMERIC, FOLD, 0x20).astype(np.uint8)
_FOLD_BYTES = FOLD.tobytes()


def normal_line(line: str) -> str:
    """Words of the line in lower case, digits as 0, one blank between words."""
    folded = line.encode("utf-8", "surrogatepass").translate(_FOLD_BYTES)
    return b" ".join(folded.split()).decode("utf-8", "surrogatepass")


def _lines(text: str) -> list[str]:
    return text.split("\n") if text else []


# Words of the lines whose blocks are worked out at once; a longer single line is a step of its own.
STEP_WORDS = 1 << 16


def _different(hashes: np.ndarray, line_of: np.ndarray) -> np.ndarray:
    """Places of one occurrence of each word in its line, in order."""
    tags = mixed(hashes ^ mixed(line_of.astype(np.uint64) + np.uint64(1)))
    slots = np.zeros(1 << max(10, len(tags).bit_length() + 1), np.int64)
    found, rest, turn = [], np.arange(len(tags)), 0
    while len(rest):
        # The last place that is put into a slot stays there; words that lost it to another word try other slots.
        at = (mixed(tags[rest] + np.uint64(turn)) if turn else tags[rest]) & np.uint64(len(slots) - 1)
        slots[at] = rest
        stays = slots[at]
        found.append(rest[stays == rest])
        rest, turn = rest[tags[stays] != tags[rest]], turn + 1
    return np.sort(np.concatenate(found)) if found else rest


# The bits of a byte as eight counters of a byte each, which are added as one number.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_COUNTER_MOST = 255


def _ones(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each line's values, `counts` of them in order, have each of their first 32 bits set. No count is zero."""
    # A counter holds so many; a line of more values is summed in runs.
    runs = -(-counts // _COUNTER_MOST)
    ends = np.cumsum(counts)
    first = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first, runs)
    begins = np.repeat(ends - counts, runs) + within * _COUNTER_MOST
    stops = np.append(begins[1:], len(values))
    octets = values.view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(begins), 4), np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    for i in range(4):
        # The total wraps around; differences do not.
        np.cumsum(_COUNTERS[octets[:, i]], out=total[1:])
        sums[:, i] = total[stops] - total[begins]
    ones = sums.view(np.uint8)
    return ones if len(ones) == len(counts) else np.add.reduceat(ones, first, axis=0, dtype=np.int32)


def _blocks(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Every block of lines whose words begin at `begins`, which ends with the number of words. No line is without words."""
    sizes = np.diff(begins)
    lots = mixed(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)).view(np.uint8).reshape(-1, 8)
    blocks = np.zeros((len(sizes), BLOCKS), np.int64)
    for k in range(BLOCKS):
        below = np.full(len(sizes), VOTING[0])
        for more in VOTING[1:]:
            counts = np.diff(np.concatenate([[0], np.cumsum(lots[:, k] < np.repeat(below, sizes))])[begins])
            below = np.where(counts < LEAST_VOTERS, more, below)
        chosen = np.flatnonzero(lots[:, k] < np.repeat(below, sizes))
        counts = np.diff(np.searchsorted(chosen, begins))
        salted = mixed(hashes[chosen] ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        bits = 2 * _ones(salted, counts).astype(np.int32) > counts[:, None]
        packed = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
        blocks[:, k] = packed & np.uint32((1 << BLOCK_BITS) - 1)
    return blocks


def _parsed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the lines: hash and length of each, where the words of each line begin (and end), and 128 bits of every line."""
    data, offsets = joined([line.replace("\n", " ") for line in lines])
    data = FOLD[data]
    starts, ends = word_places(data, ALPHANUMERIC)
    # The line feed between lines was folded to a blank, which still parts words.
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    full = np.flatnonzero(counts)
    keys = np.zeros((len(lines), 2), np.uint64)
    if len(full):
        begins = bounds[:-1][full]
        place = (np.arange(len(hashes)) - np.repeat(begins, counts[full])).astype(np.uint64)
        for column, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            keys[full, column] = np.add.reduceat(mixed(hashes ^ mixed(place * np.uint64(salt) + np.uint64(column))), begins)
    return hashes, ends - starts, bounds, keys


def line_signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line: 128 bits of its words in order, as two columns; its blocks, two to a column; length when normalised."""
    hashes, sizes, bounds, keys = _parsed(lines)
    counts = np.diff(bounds)
    full = np.flatnonzero(counts)
    sims = np.zeros((len(lines), BLOCKS // 2), np.int64)
    lengths = np.zeros(len(lines), np.int64)
    if len(full):
        lengths[full] = np.add.reduceat(sizes, bounds[:-1][full]) + counts[full] - 1
        line_of = np.repeat(np.arange(len(full)), counts[full])
        kept = _different(hashes, line_of)
        begins = np.concatenate([[0], np.cumsum(np.bincount(line_of[kept], minlength=len(full)))])
        first = 0
        while first < len(full):
            last = max(first + 1, int(np.searchsorted(begins, begins[first] + STEP_WORDS, side="right")) - 1)
            low, high = begins[first], begins[last]
            blocks = _blocks(hashes[kept[low:high]], begins[first : last + 1] - low)
            sims[full[first:last]] = blocks[:, 0::2] | blocks[:, 1::2] << 32
            first = last
    return keys, sims, lengths


def _split_all(texts: list[str]) -> tuple[list[str], pa.Array]:
    split = [_lines(t) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(lines) for lines in split])]).astype(np.int32)
    return [line for lines in split for line in lines], pa.array(ends)


def _nodes(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


SIMS = tuple(f"sim{i}" for i in range(BLOCKS // 2))


def _signer():
    def sign(texts: list[str]) -> list:
        lines, ends = _split_all(texts)
        keys, sims, lengths = line_signatures(lines)
        nested = lambda values: pa.ListArray.from_arrays(ends, values)
        return [nested(_nodes(keys)), *[nested(pa.array(s)) for s in sims.T], nested(pa.array(lengths.astype(np.int32)))]

    return sign


def signed_lines(text: Column) -> Column:
    """Arrays `node`, `sim0` to `sim2` and `size` of the lines of whole texts; lines without words have size 0."""
    types = {"node": pa.list_(pa.binary()), **{s: pa.list_(pa.int64()) for s in SIMS}, "size": pa.list_(pa.int32())}
    ddl = ", ".join(["node array<binary>", *[f"{s} array<bigint>" for s in SIMS], "size array<int>"])
    return text_function(ddl, types, _signer)(text)


def spelt_lines(text: Column, places: Column) -> Column:
    """Structs of `at`, `own` (the node) and `line` (normalised) of the lines of whole texts at `places`, an array of line numbers."""

    def run(batches: collections.abc.Iterator[tuple[pa.Array, pa.Array]]) -> collections.abc.Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("own", pa.binary()), ("line", pa.string())]))
        for texts, wanted in batches:
            parts, done = [pa.array([], kind)], 0
            for piece in slices(texts):
                asked = wanted.slice(done, len(piece))
                done += len(piece)
                told = [(at, lines[at]) for t, ats in zip(piece.to_pylist(), asked.to_pylist()) for lines in [_lines(t)] for at in ats]
                ends = np.concatenate([[0], np.cumsum([len(ats) for ats in asked.to_pylist()])]).astype(np.int32)
                lines = [line for _, line in told]
                arrays = [pa.array([at for at, _ in told], pa.int32()), _nodes(_parsed(lines)[3]), pa.array([normal_line(x) for x in lines], pa.string())]
                parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, fields=list(kind.value_type))))
            yield pa.concat_arrays(parts)
        release_memory()

    run.__annotations__ = {
        "batches": collections.abc.Iterator[tuple[pa.Array, pa.Array]], "return": collections.abc.Iterator[pa.Array],
    }
    return F.arrow_udf(run, "array<struct<at: int, own: binary, line: string>>")(text, places)


def edit_distance(a: str, b: str, most: int) -> int:
    """Inserted, deleted and changed characters between two texts; anything over `most` once they are more than that."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b or abs(len(a) - len(b)) > most:
        return max(len(a), len(b))
    # Columns of the distance table as bits of one integer: where it grows and where it falls along `a`.
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    grows, falls, distance = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        same = places.get(c, 0)
        down = (((same & grows) + grows) ^ grows) | same | falls
        up = falls | (full & ~(down | grows))
        fall = grows & down
        distance += 1 if up & top else -1 if fall & top else 0
        if distance - left > most:
            return distance - left
        up = up << 1 | 1
        grows = full & (fall << 1 | ~(down | up))
        falls = full & up & down
    return distance


def alike(a: str, b: str) -> bool:
    """Edit similarity of two normalised lines of at least SIMILARITY."""
    part, whole = SIMILARITY
    most = (whole - part) * max(len(a), len(b)) // whole
    left, right = a.split(" "), b.split(" ")
    # Changing words where they stand is one way to edit; where that is few enough edits, the least number need not be known.
    if len(left) == len(right) and sum(max(len(x), len(y)) for x, y in zip(left, right) if x != y) <= most:
        return True
    return edit_distance(a, b, most) <= most


def _alike_column(left: Column, right: Column) -> Column:
    """`alike` of two columns. Only long lines are compared in Python, as the engine's own distance takes more time for them."""
    part, whole = SIMILARITY
    longer = F.greatest(F.char_length(left), F.char_length(right))
    most = ((whole - part) * longer / whole).cast("int")
    near = F.call_function("levenshtein", left, right, most) >= 0

    def run(batches: collections.abc.Iterator[tuple[pa.Array, pa.Array]]) -> collections.abc.Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([x is not None and alike(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    run.__annotations__ = {
        "batches": collections.abc.Iterator[tuple[pa.Array, pa.Array]], "return": collections.abc.Iterator[pa.Array],
    }
    is_long = longer > LONG_LINE
    told = F.arrow_udf(run, "boolean")(F.when(is_long, left), F.when(is_long, right))
    return F.when(is_long, told).otherwise(near)


def block_keys(sims: list[Column], size: Column) -> Column:
    """Keys of the groups a line stands in: each of its blocks within its class of length, and within the class below where a
    line of that class could be alike."""
    part, whole = SIMILARITY
    own = F.floor(F.log(size) / float(np.log(CLASS_RATIO)))
    lowest = F.floor(F.log(size * part / whole) / float(np.log(CLASS_RATIO)))
    bits = [F.call_function("shiftright", sims[i // 2], F.lit(32 * (i % 2))).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(BLOCKS)]
    within = lambda c: [F.xxhash64(F.lit(i), b, c) for i, b in enumerate(bits)]
    return F.when(own == lowest, F.array(*within(own))).otherwise(F.array(*within(own), *within(lowest)))


def _likely(left, right) -> Column:
    part, whole = SIMILARITY
    sizes = (whole * left("size") >= part * right("size")) & (whole * right("size") >= part * left("size"))
    apart = [F.bit_count(left(s).bitwiseXOR(right(s))) for s in SIMS]
    return sizes & (sum(apart[1:], apart[0]) <= MOST_BITS)


def line_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for every row of `docs`: (id, n_lines, dropped), `dropped` being the numbers from 0 of lines to drop, in order.

    Lines are parted by line feeds and normalised to words in lower case, with digits as 0. Two lines are linked when they are
    equal then, or when their edit similarity is at least SIMILARITY and their SimHashes have a block in common and differ in
    MOST_BITS bits at most. Nearly all pairs of that similarity meet; README has the measured share. Of every connected group one occurrence stays: that of the least id, null ids last, then the first line; of repeated rows the
    first. Lines without words are never dropped. Null and empty texts have no lines. Ids may be of any orderable type.

    Equal lines fall together first, by one aggregation, so a line that stands in a third of all texts is one row from there on.
    Different lines meet in groups of one block of bits and a class of length, as `linking` describes. The texts of lines are
    read again only where a bitmap of the wanted ones lets them through.
    """
    base = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    rows = written(
        base.select("_id", F.xxhash64("_text").alias("_mark"), signed_lines(F.col("_text")).alias("s"))
        .select("_id", "_mark", "s.*")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    place = F.struct(
        F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"), F.col("at").alias("at"), F.col("_mark").alias("m")
    )
    def occurrences(*columns: str) -> DataFrame:
        told = rows.select("_id", "_mark", "_row", F.posexplode(F.arrays_zip("node", "size", *columns)).alias("at", "l"))
        return told.select("_id", "_mark", "_row", "at", "l.*").filter("size > 0")

    lines = written(
        occurrences(*SIMS).groupBy("node").agg(
            F.min(place).alias("_first"), F.count("*").alias("_count"), *[F.min(c).alias(c) for c in (*SIMS, "size")]
        )
    )
    nodes = lines.select("node", block_keys([F.col(s) for s in SIMS], F.col("size")).alias("keys"), *SIMS, "size")

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, lines, base)

    labels, _ = linked(nodes, _likely, verify, sparse=True)
    # A line that stands once and is linked with no other loses nothing, and need not move.
    several = marked(lines, F.col("node"), bitmap_of(labels, "node"), "_may").filter(F.col("_may") | (F.col("_count") > 1))
    grouped = several.select("node", "_first", "_count").join(labels, "node", "left").withColumn("_label", F.coalesce("label", "node"))
    kept = grouped.groupBy("_label").agg(F.min("_first").alias("_kept"), F.sum("_count").alias("_all"))
    # Lines of groups with more than one occurrence: only these can lose any.
    repeated = written(grouped.join(kept.filter("_all > 1"), "_label").select(F.col("node").alias("_node"), "_kept"))
    losers = sifted(occurrences(), F.col("node"), bitmap_of(repeated, "_node")).join(repeated, F.col("node") == F.col("_node"))
    dropped = (
        losers.filter((F.col("_row") != F.col("_kept.r")) | (F.col("at") != F.col("_kept.at")))
        .groupBy(F.col("_row").alias("_of")).agg(F.array_sort(F.collect_list("at")).alias("dropped"))
    )
    counted = rows.select("_id", "_row", F.size("node").cast("bigint").alias("n_lines"))
    return counted.join(dropped, F.col("_row") == F.col("_of"), "left").select(
        F.col("_id").alias(id_column), "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without its dropped lines."""
    kept = F.filter(F.split(text, "\n"), lambda line, at: ~F.array_contains(dropped, at))
    return F.array_join(kept, "\n")


def _verified(pairs: DataFrame, lines: DataFrame, base: DataFrame) -> DataFrame:
    """The pairs of lines that are alike, by the words of one occurrence of each.

    Rows are found by id and a hash of their text, so that rows which share an id, or have none, are no group of their own. A line
    that is found has to be the one looked for: its own node is worked out again.
    """
    holder = lambda n, i, m: F.struct(n.alias("n"), i.alias("i"), m.alias("m"))
    wanted = written(pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct())
    of = holder(F.col("_first.n"), F.col("_first.i"), F.col("_first.m"))
    some = sifted(lines.select("node", "_first"), F.col("node"), bitmap_of(wanted, "_node"))
    held = wanted.join(some, F.col("_node") == F.col("node")).select("_node", of.alias("_of"), F.col("_first.at").alias("_at"))
    # A text has so many lines at most.
    held = written(held.groupBy("_of").agg(F.collect_list("_at").alias("_places"), F.collect_list("_node").alias("_nodes")))
    rows = base.select(holder(F.col("_id").isNull(), F.col("_id"), F.xxhash64("_text")).alias("_holder"), "_text")
    texts = sifted(rows, F.col("_holder"), bitmap_of(held, "_of")).dropDuplicates(["_holder"])
    told = held.join(texts, F.col("_of") == F.col("_holder")).select("_nodes", spelt_lines(F.col("_text"), F.col("_places")).alias("s"))
    near = told.select(F.explode(F.arrays_zip("_nodes", "s")).alias("z")).select(F.col("z._nodes").alias("_node"), "z.s.own", "z.s.line")
    found = written(near.filter(F.col("own") == F.col("_node")).select("_node", "line"))
    left = found.withColumnsRenamed({"_node": "_l", "line": "_left"})
    right = found.withColumnsRenamed({"_node": "_r", "line": "_right"})
    both = pairs.join(left, F.col("a") == F.col("_l")).join(right, F.col("b") == F.col("_r"))
    return both.filter(_alike_column(F.col("_left"), F.col("_right"))).select("a", "b").distinct()
