"""MinHash near-duplicates, with odd sketches to tell likely links from chance candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.llm.columns import SLICE_BYTES, release_memory, text_function
from prefweave.llm.linking import linked
from prefweave.llm.sieve import bitmap_of, sifted
from prefweave.llm.storage import written
from prefweave.llm.words import NOT_BLANK, joined, mixed, word_hashes, word_places

SHINGLE = 5
THRESHOLD = (75, 100)
# 32 bands of 4 of 128 samples: a pair at the threshold shares no band with a chance of (1 - 0.75^4)^32, or 5 in a million.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
# A pair at the threshold has about 50 odd bits of 256, with a deviation of some 9 (from sampling and from collisions). Pairs
# with more than this many, which is over five deviations, are no links.
MOST_ODD_BITS = 100
# Sets of groups that hold several components get sharper sketches: there a pair at the threshold has about 806 odd bits of
# 4,096, with a deviation of some 30, and pairs with more than this many are less alike than 0.69.
SHARP_SAMPLES, SHARP_BITS, SHARP_MOST_ODD_BITS = 2048, 4096, 960
# Stated constants: seeded multipliers for shingles and samples.
_RANDOM = np.random.default_rng(20240301)
PLACES = _RANDOM.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
MULTIPLIERS = _RANDOM.integers(0, 1 << 64, SAMPLES, np.uint64) | np.uint64(1)
BAND_PLACES = _RANDOM.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)
SAMPLE_SALTS = _RANDOM.integers(0, 1 << 64, SHARP_SAMPLES, np.uint64)
SHARP_MULTIPLIERS = _RANDOM.integers(0, 1 << 64, SHARP_SAMPLES, np.uint64) | np.uint64(1)


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, repeats included, and where those of each text begin (one end more).

    A text of fewer words than a shingle has one shingle of all its words; a text without words has none.
    """
    data, offsets = joined(texts)
    starts, ends = word_places(data, NOT_BLANK)
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    sizes = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    first = np.arange(begins[-1]) - np.repeat(begins[:-1], sizes) + np.repeat(bounds[:-1], sizes)
    left = np.minimum(np.repeat(words, sizes), SHINGLE)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    total = left.astype(np.uint64)
    for i, factor in enumerate(PLACES):
        total = total + np.where(left > i, padded[first + i] * factor, np.uint64(0))
    return mixed(total), begins


def signatures(hashes: np.ndarray, begins: np.ndarray, multipliers: np.ndarray = MULTIPLIERS) -> np.ndarray:
    """(samples, sets): the least value of every sample over each non-empty set."""
    found = np.empty((len(multipliers), len(begins)), np.uint64)
    for i, factor in enumerate(multipliers):
        found[i] = np.minimum.reduceat(hashes * factor, begins)
    return found


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(sets, BANDS): one key per band of ROWS samples."""
    keys = np.zeros((samples.shape[1], BANDS), np.uint64)
    for band in range(BANDS):
        total = np.full(samples.shape[1], band + 1, np.uint64)
        for row in range(ROWS):
            total += mixed(samples[band * ROWS + row]) * BAND_PLACES[row]
        keys[:, band] = mixed(total)
    return keys


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(sets, bits / 64): each sample turns over one bit, so that two sketches differ by the odd bits of what differs."""
    k, n = samples.shape
    width = bits.bit_length() - 1
    place = (mixed(samples + SAMPLE_SALTS[:k, None]) >> np.uint64(64 - width)).astype(np.int64)
    odd = np.bincount((place + np.arange(n) * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(odd.reshape(n, bits).astype(np.uint8), axis=1).view(np.uint64)


def estimated_similarity(odd_bits: float, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> float:
    """The Jaccard similarity that goes with so many odd bits between two sketches."""
    return 1 + bits / (4 * samples) * float(np.log(max(1e-9, 1 - 2 * odd_bits / bits)))


def _fingerprint(distinct: np.ndarray) -> bytes:
    """128 bits that stand for a set: two sums of its mixed members, which hold the order of nothing."""
    pair = np.array([mixed(distinct).sum(), mixed(distinct ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64)
    return (mixed(pair) + np.uint64(len(distinct))).tobytes()


def _signer():
    def sign(texts: list[str]) -> list:
        hashes, begins = shingle_hashes(texts)
        sets = [np.unique(hashes[a:b]) for a, b in zip(begins[:-1], begins[1:])]
        sizes = [len(s) for s in sets]
        full = np.flatnonzero(np.diff(begins))
        keys = np.zeros((len(texts), BANDS), np.int64)
        sketches = np.zeros((len(texts), SKETCH_BITS // 64), np.int64)
        if len(full):
            samples = signatures(hashes, begins[:-1][full])
            keys[full] = band_keys(samples).view(np.int64)
            sketches[full] = odd_sketches(samples).view(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        return [np.asarray(sizes, np.int64), [_fingerprint(s) for s in sets], flat, *[np.ascontiguousarray(c) for c in sketches.T]]

    return sign


SKETCH = [f"o{i}" for i in range(SKETCH_BITS // 64)]


def signed(text: Column) -> Column:
    """`n` distinct shingles, `node` (a fingerprint of the set), `bands` and the words o0.. of the odd sketch."""
    types = {"n": pa.int64(), "node": pa.binary(), "bands": pa.list_(pa.int64()), **{o: pa.int64() for o in SKETCH}}
    ddl = "n bigint, node binary, bands array<bigint>, " + ", ".join(f"{o} bigint" for o in SKETCH)
    return text_function(ddl, types, _signer)(text)


def _sharpener():
    def sharpen(texts: list[str]) -> list:
        hashes, begins = shingle_hashes(texts)
        nodes = [_fingerprint(np.unique(hashes[a:b])) for a, b in zip(begins[:-1], begins[1:])]
        full = np.flatnonzero(np.diff(begins))
        words = np.zeros((len(texts), SHARP_BITS // 64), np.int64)
        for at in range(0, len(full), 32):
            some = full[at : at + 32]
            low, high = begins[some[0]], begins[some[-1] + 1]
            samples = signatures(hashes[low:high], begins[some] - low, SHARP_MULTIPLIERS)
            words[some] = odd_sketches(samples, SHARP_BITS).view(np.int64)
        return [nodes, list(words)]

    return sharpen


def _sharp(text: Column) -> Column:
    types = {"own": pa.binary(), "sharp": pa.list_(pa.int64())}
    return text_function("own binary, sharp array<bigint>", types, _sharpener)(text)


def _comparer():
    part, whole = THRESHOLD

    def compare(texts: list[tuple[str, str]]) -> list:
        nodes, alike = [[], []], []
        hashes, begins = shingle_hashes([t for pair in texts for t in pair])
        sets = [np.unique(hashes[a:b]) for a, b in zip(begins[:-1], begins[1:])]
        for a, b in zip(sets[0::2], sets[1::2]):
            both = len(np.intersect1d(a, b, assume_unique=True))
            nodes[0].append(_fingerprint(a))
            nodes[1].append(_fingerprint(b))
            alike.append(whole * both >= part * (len(a) + len(b) - both))
        return [*nodes, alike]

    return compare


def compared(left: Column, right: Column) -> Column:
    """Fingerprints of the full shingle sets of two texts, and whether the sets are `alike`."""
    import collections.abc

    work = _comparer()
    fields = [pa.field("left", pa.binary()), pa.field("right", pa.binary()), pa.field("alike", pa.bool_())]

    def run(batches: collections.abc.Iterator[tuple[pa.Array, pa.Array]]) -> collections.abc.Iterator[pa.Array]:
        for a, b in batches:
            parts, rows, size = [pa.array([], pa.struct(fields))], [], 0
            for i, (x, y) in enumerate(zip(a, b), 1):
                rows.append((x.as_py() or "", y.as_py() or ""))
                size += len(rows[-1][0]) + len(rows[-1][1])
                if size >= SLICE_BYTES or i == len(a):
                    arrays = [pa.array(values, f.type) for values, f in zip(work(rows), fields)]
                    parts.append(pa.StructArray.from_arrays(arrays, fields=fields))
                    rows, size = [], 0
            yield pa.concat_arrays(parts)
        release_memory()

    run.__annotations__ = {
        "batches": collections.abc.Iterator[tuple[pa.Array, pa.Array]], "return": collections.abc.Iterator[pa.Array],
    }
    return F.arrow_udf(run, "left binary, right binary, alike boolean")(left, right)


def _holder() -> Column:
    """What a row is fetched by: its id, which may be null or shared by very many rows, together with a hash of its text."""
    return F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_mark").alias("m"))


def _held_texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_holder, _text): one row for each `_holder` of `wanted`, and for few others. Equal rows fall together before they move."""
    texts = base.withColumn("_mark", F.xxhash64("_text")).select(_holder().alias("_holder"), "_text")
    return sifted(texts, F.col("_holder"), bitmap_of(wanted, "_holder")).dropDuplicates(["_holder"])


def _likely(left, right) -> Column:
    """Set sizes and odd sketches allow a link."""
    part, whole = THRESHOLD
    sizes = (whole * left("n") >= part * right("n")) & (whole * right("n") >= part * left("n"))
    odd = sum((F.bit_count(left(o).bitwiseXOR(right(o))) for o in SKETCH), F.lit(0))
    return sizes & (odd <= MOST_ODD_BITS)


def _surely(left, right) -> Column:
    """As `_likely`, with the sharper sketches."""
    odd = F.zip_with(left("sharp"), right("sharp"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return _likely(left, right) & (F.aggregate(odd, F.lit(0), lambda total, x: total + x) <= SHARP_MOST_ODD_BITS)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of `docs` with its component of near-duplicates: (id, n_shingles, component_id, kept).

    Texts are linked when the Jaccard similarity of their sets of five-word shingles is at least 0.75. `component_id` is the
    least id reachable; null ids count only where a component has no other, and such a component has a null
    `component_id`, of which every row stays. `kept` says that the id is the component's: repeated rows of one id share their fate. Texts
    without words are linked with nothing, null ones included. An empty table gives no rows. Ids may be of any orderable type.

    Rows whose sets are equal fall together first, by one aggregation on a fingerprint of the set, so copies cost nothing
    more. Each different set then goes to 32 band groups, whose members are compared as `linking` describes: sketches reject
    what cannot be a link, and full sets decide. Texts are shuffled only where a bitmap of the wanted ids lets them through.
    """
    base = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    marked = base.select("_id", F.xxhash64("_text").alias("_mark"), signed(F.col("_text")).alias("s"))
    rows = written(marked.select("_id", "_mark", "s.*"))
    filled = rows.filter("n > 0")
    sets = written(filled.groupBy("node").agg(F.min("_id").alias("_id"), F.min(_holder()).alias("_holder"), F.first("n").alias("n"), F.first("bands").alias("bands"),
                                              *[F.first(o).alias(o) for o in SKETCH]))
    nodes = sets.select("node", F.array_distinct("bands").alias("keys"), "n", *SKETCH)
    holders = sets.select("node", "_holder")

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, holders, base)

    def sharpen(left: DataFrame) -> DataFrame:
        held = written(left.join(holders, "node"))
        texts = _held_texts(base, held).withColumnRenamed("_holder", "_h")
        own = held.join(texts, F.col("_holder") == F.col("_h")).select("node", _sharp(F.col("_text")).alias("s"))
        told = own.filter(F.col("s.own") == F.col("node")).dropDuplicates(["node"]).select("node", "s.sharp")
        return told.join(nodes, "node")

    labels, _ = linked(nodes, _likely, verify, sharpen, _surely)
    places = sets.select("node", "_id").join(labels, "node", "left").select("node", "_id", F.coalesce("label", "node").alias("_label"))
    least = places.groupBy("_label").agg(F.min("_id").alias("component_id"))
    told = written(places.join(least, "_label").select(F.col("node").alias("_node"), "component_id"))
    # Rows without words have one node for all of them: spread over tasks, as they match nothing.
    spread = F.when(F.col("n") > 0, F.col("node")).otherwise(F.encode(F.concat(F.lit("none:"), F.xxhash64("_id").cast("string")), "UTF-8"))
    placed = rows.withColumn("_key", spread).join(told, F.col("_key") == F.col("_node"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return placed.select(
        F.col("_id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def _verified(pairs: DataFrame, holders: DataFrame, base: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are alike, by the texts of one row of each set."""
    held = pairs.join(holders.withColumnsRenamed({"node": "a", "_holder": "_left"}), "a")
    held = written(held.join(holders.withColumnsRenamed({"node": "b", "_holder": "_right"}), "b"))
    wanted = held.select(F.col("_left").alias("_holder")).union(held.select("_right"))
    texts = _held_texts(base, wanted)
    left = texts.withColumnsRenamed({"_holder": "_l", "_text": "_left_text"})
    right = texts.withColumnsRenamed({"_holder": "_r", "_text": "_right_text"})
    both = held.join(left, F.col("_left") == F.col("_l")).join(right, F.col("_right") == F.col("_r"))
    found = both.select("a", "b", compared(F.col("_left_text"), F.col("_right_text")).alias("c"))
    same = (F.col("c.left") == F.col("a")) & (F.col("c.right") == F.col("b"))
    return found.filter(same & F.col("c.alike")).select("a", "b").distinct()
