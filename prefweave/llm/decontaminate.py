"""Benchmark decontamination: an FM-index per shard of documents, searched for every window of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.llm.columns import text_function
from prefweave.llm.fm_index import FmIndex
from prefweave.llm.storage import Shipped, written
from prefweave.llm.words import ALPHANUMERIC, joined, word_hashes, word_places

WINDOW = 13
# Text of the documents that one index holds, and of the benchmark items that are searched for in one pass.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20


@dataclass
class Phrases:
    """Windows of a block of items. Symbols from 1 on stand for the words of the block."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 1
    windows: list[np.ndarray]  # one matrix of symbols per window length
    owners: list[tuple[np.ndarray, np.ndarray]]  # per matrix: where the owners of each row begin (one end more), and all owners
    items: list[str]  # an owner is a place in this list; items without an id own nothing, but their windows are here
    shortest: int


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... as often as each of the `counts` says."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def phrases_of(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    """Distinct windows of `window` words of every item; an item of fewer words, but not none, is one window."""
    items = sorted({i for i, _ in rows if i is not None})
    place = {i: p for p, i in enumerate(items)}
    owner = np.array([place.get(i, -1) for i, _ in rows], np.int64)
    data, offsets = joined([text or "" for _, text in rows])
    starts, ends = word_places(data, ALPHANUMERIC)
    hashes = word_hashes(data, starts, ends)
    vocabulary = np.unique(hashes)
    symbols = (np.searchsorted(vocabulary, hashes) + 1).astype(np.int32)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    sizes = np.minimum(words, window)
    windows, owners = [], []
    for size in np.unique(sizes[sizes > 0]).tolist():
        mine = np.flatnonzero(sizes == size)
        counts = words[mine] - size + 1
        first = np.repeat(bounds[:-1][mine], counts) + ramp(counts)
        every = symbols[first[:, None] + np.arange(size)]
        distinct, row = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([row.ravel(), np.repeat(owner[mine], counts)]), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        windows.append(distinct)
        owners.append((np.searchsorted(pairs[0], np.arange(len(distinct) + 1)), pairs[1]))
    return Phrases(vocabulary, windows, owners, items, int(sizes[sizes > 0].min()) if (sizes > 0).any() else window)


def shard_index(symbols: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[FmIndex, np.ndarray]:
    """The index of a shard, and for each of its places the word it stands for, -1 for ends of segments.

    A segment is a run of words of one text that the phrases hold too. Other words, and segments shorter than the shortest
    window, can be part of no occurrence and are left out.
    """
    known = symbols > 0
    starts_text = np.zeros(len(symbols) + 1, bool)
    starts_text[bounds] = True
    opens = np.flatnonzero(known & (np.concatenate([[True], ~known[:-1]]) | starts_text[:-1]))
    closes = np.flatnonzero(known & (np.concatenate([~known[1:], [True]]) | starts_text[1:])) + 1
    long_enough = closes - opens >= phrases.shortest
    opens, closes = opens[long_enough], closes[long_enough]
    sizes = closes - opens
    out = np.concatenate([[0], np.cumsum(sizes + 1)])
    word = np.full(out[-1], -1, np.int64)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    word[np.repeat(out[:-1], sizes) + inside] = np.repeat(opens, sizes) + inside
    sequence = np.where(word >= 0, symbols[word], 0) if len(word) else np.zeros(0, np.int64)
    return FmIndex(sequence, len(phrases.vocabulary) + 1), word


def search_shard(texts: list[str], phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Per text: number of words; merged spans of hit words, end exclusive; sorted ids of the items found."""
    data, offsets = joined(texts)
    starts, ends = word_places(data, ALPHANUMERIC)
    bounds = np.searchsorted(starts, offsets)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    counts = np.diff(bounds)
    if not len(phrases.vocabulary) or not len(starts):
        return counts, spans, items
    hashes = word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    symbols = np.where(phrases.vocabulary[at] == hashes, at + 1, 0)
    index, word = shard_index(symbols, bounds, phrases)
    if not len(word):
        return counts, spans, items
    edge = np.zeros(len(starts) + 1, np.int64)
    pairs = []
    for windows, (begins, owners) in zip(phrases.windows, phrases.owners):
        low, high = index.search(windows)
        hit = np.flatnonzero(low < high)
        sizes = (high - low)[hit]
        if not len(hit):
            continue
        rows = np.repeat(low[hit], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = word[index.locate(rows)]
        np.add.at(edge, first, 1)
        np.add.at(edge, first + windows.shape[1], -1)
        text = np.searchsorted(bounds, first, side="right") - 1
        # Each pair of text and window once, then the items of the window.
        pair = np.unique(text * len(windows) + np.repeat(hit, sizes))
        of = pair % len(windows)
        counts_of = begins[of + 1] - begins[of]
        own = owners[np.repeat(begins[of], counts_of) + ramp(counts_of)]
        pairs.append(np.repeat(pair // len(windows), counts_of) * len(phrases.items) + own)
    covered = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
    # Spans end with their text: windows never reach over its end, but neighbours may touch.
    change = np.diff(covered)
    for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
        text = int(np.searchsorted(bounds, a, side="right")) - 1
        while a < b:
            end = min(b, bounds[text + 1])
            if a < end:
                spans[text].append((int(a - bounds[text]), int(end - bounds[text])))
            a, text = end, text + 1
    if pairs:
        for pair in np.unique(np.concatenate(pairs)):
            items[pair // len(phrases.items)].append(phrases.items[pair % len(phrases.items)])
    return counts, spans, items


def hits(text: Column, phrases) -> Column:
    """`n_words`, merged `starts` and `ends` of hit words, and `items` found in whole texts, by broadcast Phrases.

    A word is hit if it lies inside any occurrence of a window of any item. Null and empty texts have no words. Every shard
    of neighbouring texts, SHARD_BYTES of them or one longer text, gets an index of its own; a text is never cut.
    """

    def make():
        told: Phrases = phrases.value

        def find(texts: list[str]) -> list:
            counts, spans, items = search_shard(texts, told)
            return [counts, [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans], items]

        return find

    types = {
        "n_words": pa.int64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "items": pa.list_(pa.string()),
    }
    ddl = "n_words bigint, starts array<int>, ends array<int>, items array<string>"
    return text_function(ddl, types, make, SHARD_BYTES)(text)


def phrase_blocks(benchmark: DataFrame, id_column: str, text_column: str, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """The items in blocks of about `limit` bytes, dealt by a hash of id and text: each block is small enough to ship."""
    items = benchmark.select(F.col(id_column).cast("string").alias("i"), F.coalesce(text_column, F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(total // limit) + 1
    for block in range(blocks):
        yield [(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().collect()]


def merged_hits(found: list[str]) -> Column:
    """Number of hit words over the spans of several blocks: lay the spans on one line in order, and sum what is new."""
    spans = F.flatten(F.array(*[F.arrays_zip(F.col(f"{f}.starts").alias("a"), F.col(f"{f}.ends").alias("b")) for f in found]))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n"))

    def add(state: Column, span: Column) -> Column:
        begin = F.greatest(state["to"], span["a"])
        return F.struct(
            F.greatest(state["to"], span["b"]).alias("to"),
            (state["n"] + F.greatest(F.lit(0), span["b"] - begin)).cast("bigint").alias("n"),
        )

    return F.aggregate(F.array_sort(spans), zero, add, lambda state: state["n"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", name: str = "found", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add the struct `name` to every row of `docs`: n_words, n_hit, items (sorted as strings), contaminated.

    A row is contaminated if a word is hit and at least one word in twenty is. Words inside windows of items with a null id are
    hit like any others; only the list of ids goes without them. Items with equal ids count as one; an empty benchmark hits
    nothing. Rows never move: each task indexes its own shards. A benchmark of more than `block_bytes` is searched block by
    block: what one block finds is written before the next is shipped, so the tasks hold one block at a time.
    """
    spark = docs.sparkSession
    frame, columns, before = docs, [], None
    for i, rows in enumerate(phrase_blocks(benchmark, item_column, item_text, block_bytes)):
        if before is not None:
            frame = written(frame)
            before.packed.destroy()
        before = Shipped(spark, phrases_of(rows))
        columns.append(f"_{name}_{i}")
        frame = frame.withColumn(columns[-1], hits(F.col(text_column), before))
    words, hit = F.col(f"{columns[0]}.n_words"), merged_hits(columns)
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{c}.items") for c in columns]))))
    frame = frame.withColumn(f"_{name}_hit", hit)
    hit = F.col(f"_{name}_hit")
    told = F.struct(
        words.alias("n_words"), hit.alias("n_hit"), items.alias("items"),
        ((hit > 0) & (20 * hit >= words)).alias("contaminated"),
    )
    return frame.withColumn(name, told).drop(*columns, f"_{name}_hit")
