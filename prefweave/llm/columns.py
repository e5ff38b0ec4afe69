"""Column functions that run Python over whole texts in bounded slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Text that one Arrow batch, and one step inside a task, may hold; a longer single text makes a step of its own.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, unless they are bounded more tightly already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str((1 << 31) - 1)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of neighbouring texts of at most `limit` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(texts)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def release_memory() -> None:
    """Give freed memory back to the system, as the worker lives on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def text_function(ddl: str, types: dict[str, pa.DataType], make: Callable[[], Callable], limit: int = SLICE_BYTES):
    """A Column function from text to a struct of the fields in `types`.

    `make` is called once per task and gives a function from a list of texts (null: empty) to one list or array per field.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work, batch = make(), None
        kind = pa.struct(list(types.items()))
        for batch in batches:
            parts = []
            for piece in slices(batch, limit):
                found = work([t or "" for t in piece.to_pylist()])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(found, types.values())]
                parts.append(pa.StructArray.from_arrays(arrays, fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
            del parts
        del work, batch
        release_memory()

    return F.arrow_udf(run, ddl)


def spans_digest(spans: Column) -> Column:
    """SHA-256 of spans given as one string."""
    return F.sha2(spans, 256)
