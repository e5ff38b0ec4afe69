"""Word dictionaries of any size: 12 bytes a word, the frequent words shipped, the others met in a join."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from prefweave.durable import durable
from prefweave.operators.skew import Load, lookup

# Functions of this module travel to the executors by value, which need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A fingerprint and an id.
ENTRY_BYTES = 12
# Bytes of entries that are shipped to every task at most.
SHIPPED_BYTES = 256 << 20
# Bytes of entries that pass the driver at once.
BLOCK_BYTES = 8 << 20
# Text and ids that one Arrow batch may hold, whatever the number of its rows.
BATCH_BYTES = 4 << 20
# Stands for a word that the shipped entries do not hold; no id is that low.
_OPEN = -(1 << 31)
# Bytes of an id, and of the ids of the rows that meet their open words in one task.
ID_BYTES = 4
GROUP_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless they are bounded more tightly already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str((1 << 31) - 1)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def word_fingerprint(word: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), word)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a task as one row: first fingerprint, all fingerprints, all ids."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    words, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*parts)) or [(), ()]))
    if len(words):
        row = [[int(words[0])], [words.astype(np.int64).tobytes()], [ids.astype(np.int32).tobytes()]]
        types = [pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["first", "words", "ids"])


class Entries:
    """Fingerprints and ids in the order of the fingerprints, shipped in blocks.

    Tasks sort and pack them; one block after the other passes the driver, which keeps none. Each block is a broadcast of its own.
    """

    def __init__(self, entries: DataFrame, rows: int, block: int):
        spark = entries.sparkSession
        dealt = entries.repartitionByRange(max(1, -(-rows * ENTRY_BYTES // block)), "word").sortWithinPartitions("word", "id")
        packed = dealt.mapInArrow(_packed, "first bigint, words binary, ids binary")
        self.firsts: list[int] = []
        self.blocks: list[Broadcast] = []
        held: list[Row] = []

        def ship() -> None:
            words, ids = b"".join(r["words"] for r in held), b"".join(r["ids"] for r in held)
            self.firsts.append(held[0]["first"])
            self.blocks.append(spark.sparkContext.broadcast((np.frombuffer(words, np.int64), np.frombuffer(ids, np.int32))))
            held.clear()

        # Ranges come in order; small neighbours share a block.
        for row in packed.toLocalIterator():
            if held and sum(len(r["words"]) + len(r["ids"]) for r in [*held, row]) > block:
                ship()
            held.append(row)
        if held:
            ship()

    @property
    def value(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints and ids, in order."""
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int32))
        return tuple(np.concatenate(x) for x in zip(empty, *[b.value for b in self.blocks]))

    def search(self, words: np.ndarray, missing: int) -> np.ndarray:
        """The id of each fingerprint."""
        # Each word of a batch is searched once, in order, which keeps the searches close together.
        distinct, back = np.unique(words, return_inverse=True)
        found = np.full(len(distinct), missing, np.int32)
        cuts = np.append(np.searchsorted(distinct, np.array(self.firsts, np.int64)), len(distinct))
        for block, begin, end in zip(self.blocks, cuts, cuts[1:]):
            if begin < end:
                known, ids = block.value
                wanted = distinct[begin:end]
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                found[begin:end] = np.where(known[at] == wanted, ids[at], np.int32(missing))
        return found[back]


def _ends(batch: pa.Array) -> np.ndarray:
    sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)])


def _nested(ends: np.ndarray, values: np.ndarray, nulls: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=nulls)


class WordDictionary:
    """The ids of the words of a vocabulary (token, id), for texts of any number and a vocabulary of any size.

    Words are told apart by 64-bit fingerprints, under a salt for which no two words of the vocabulary share one. A word that the
    vocabulary lacks could still be taken for one of its n words, with a chance of n / 2^64.

    Up to `limit` bytes of entries, those of the lowest ids, which are the most frequent words, are shipped to the tasks, sorted by
    fingerprint, and searched in whole Arrow batches without building anything. Where that is all of them, encoding neither
    explodes nor shuffles. Otherwise only the words that are left open, which are rare, meet the other entries in a join on
    fingerprints: a task holds `limit` bytes and its share of that join, whatever the size of the vocabulary.
    """

    def __init__(self, vocab: DataFrame, limit: int = SHIPPED_BYTES, unknown: int = 1):
        spark = vocab.sparkSession
        bound_batches(spark)
        self.unknown, self.salt, self.size = unknown, 0, vocab.count()
        room = limit // ENTRY_BYTES
        while self._collides(vocab):
            self.salt += 1
        entries = vocab.select(word_fingerprint(F.col("token"), self.salt).alias("word"), "id")
        self.rest = None
        if self.size > room:
            cut = room
            low = (F.col("id") >= 0) & (F.col("id") < F.lit(cut))
            # Ids are unique, as a rule; where many words share low ones, fewer are shipped.
            while cut and entries.filter(low).count() > room:
                cut //= 2
                low = (F.col("id") >= 0) & (F.col("id") < F.lit(cut))
            self.rest = durable(entries.filter(~low))
            entries = entries.filter(low)
        # At most `limit` bytes go to the tasks, and a block of them at once through the driver.
        self.shipped = Entries(entries, min(self.size, room), BLOCK_BYTES)

    def _collides(self, vocab: DataFrame) -> bool:
        hashed = vocab.groupBy(word_fingerprint(F.col("token"), self.salt).alias("_word"))
        return not hashed.agg(F.min("token").alias("a"), F.max("token").alias("b")).filter("a <> b").isEmpty()

    @property
    def whole(self) -> bool:
        """Whether all entries are shipped."""
        return self.rest is None

    def _prints(self, words: Column) -> Column:
        salt = self.salt
        return F.transform(words, lambda word: word_fingerprint(word, salt))

    def _open(self, words: Column) -> Column:
        """Struct of `ids`, open ones included, and the fingerprints of the `open` ones, in order."""
        shipped = self.shipped

        def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                flat = batch.flatten().to_numpy(zero_copy_only=False)
                found = shipped.search(flat, _OPEN)
                ends, nulls, left = _ends(batch), pc.is_null(batch), found == _OPEN
                left_ends = np.concatenate([[0], np.cumsum(left)])[ends]
                arrays = [_nested(ends, found, nulls), _nested(left_ends, flat[left], nulls)]
                yield pa.StructArray.from_arrays(arrays, ["ids", "open"])

        return F.arrow_udf(look_up, "ids array<int>, open array<bigint>")(self._prints(words))

    def ids(self, words: Column) -> Column:
        """An array of words as ids, null for null, without leaving the row. Only where all entries are shipped."""
        if not self.whole:
            raise ValueError(f"{self.size} words are more than are shipped to every task; use encode")
        shipped, unknown = self.shipped, self.unknown

        def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = shipped.search(batch.flatten().to_numpy(zero_copy_only=False), unknown)
                yield _nested(_ends(batch), found, pc.is_null(batch))

        return F.arrow_udf(look_up, "array<int>")(self._prints(words))

    def encode(self, df: DataFrame, key: str, texts: dict[str, Column]) -> DataFrame:
        """`key` and, for each name in `texts`, the ids of that array of words; null for null.

        Beyond what is shipped, each open word of a group of rows meets its entry once, and the ids move once, to their group.
        """
        if self.whole:
            return df.select(key, *[self.ids(words).alias(name) for name, words in texts.items()])
        # Rows are told apart by a number of their own, so null and repeated keys are no group.
        opened = [self._open(words).alias(name) for name, words in texts.items()]
        marked = durable(df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), *opened))
        part, place = F.call_function("shiftright", "_row", F.lit(33)), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = [F.coalesce(F.size(f"{name}.ids"), F.lit(0)).cast("bigint") for name in texts]
        rows, ids, parts = marked.agg(F.count("*"), F.sum(sum(sizes, F.lit(0))), F.max(part)).first()
        # Rows that lie next to each other, of GROUP_BYTES together on average, meet their open words in one task.
        together = max(1, rows * GROUP_BYTES // max(1, (ids or 0) * ID_BYTES))
        grouped = marked.withColumn("_group", F.xxhash64(part, F.floor(place / together)))
        # A word is met once by each group.
        load = Load(rows, rows // together + (parts or 0) + 1)
        words = F.flatten(F.array(*[F.coalesce(F.col(f"{name}.open"), F.array().cast("array<bigint>")) for name in texts]))
        needed = grouped.select("_group", F.explode(words).alias("_word")).distinct()
        found = lookup(needed, "_word", self.rest.withColumnRenamed("id", "_id"), "word", ["_group"], "inner", load=load)
        told = found.select(F.col("_group").alias("_of"), "_word", F.col("_id").cast("int").alias("_id"))
        fields = [StructField(key, df.schema[key].dataType), *[StructField(name, ArrayType(IntegerType())) for name in texts]]
        names, unknown = list(texts), self.unknown

        def fill(rows: pa.Table, entries: pa.Table) -> pa.Table:
            return _filled(rows, entries, names, unknown).rename_columns([key, *names])

        return grouped.groupBy("_group").cogroup(told.groupBy("_of")).applyInArrow(fill, StructType(fields))


def _filled(rows: pa.Table, entries: pa.Table, names: list[str], unknown: int) -> pa.Table:
    """The keys of the rows of a group, and their ids, the open ones by the entries of its words."""
    words, ids = entries["_word"].to_numpy(), entries["_id"].to_numpy()
    order = np.lexsort((ids, words))
    words, ids = words[order], ids[order]
    columns = [rows["_key"].combine_chunks()]
    for name in names:
        known, left = (rows[name].combine_chunks().field(f) for f in ("ids", "open"))
        flat = known.flatten().to_numpy(zero_copy_only=False).copy()
        wanted, back = np.unique(left.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        told = np.full(len(wanted), unknown, np.int32)
        if len(words):
            at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
            told = np.where(words[at] == wanted, ids[at], told)
        flat[flat == _OPEN] = told[back]
        columns.append(_nested(_ends(known), flat, pc.is_null(known)))
    return pa.table(columns, names=["_key", *names])
