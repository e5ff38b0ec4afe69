"""Array expressions on token ids."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefweave import fixed_values as V


def pad(ids: Column, n, pad_id: int, side: str = "right") -> Column:
    """T4. Cut to `n` ids, then fill up to `n` with `pad_id`. `n` is a number or a Column."""
    length = n if isinstance(n, Column) else F.lit(n)
    kept = F.slice(ids, F.lit(1), length)
    filler = F.array_repeat(F.lit(pad_id), (length - F.size(kept)).cast("int"))
    return F.concat(kept, filler) if side == "right" else F.concat(filler, kept)


def attention_mask(ids: Column, n, side: str = "right") -> Column:
    """T5. 1 per token and 0 per padding place, from the length: a real token may equal the pad id."""
    length = n if isinstance(n, Column) else F.lit(n)
    real = F.least(F.size(ids), length).cast("int")
    ones = F.array_repeat(F.lit(1), real)
    zeros = F.array_repeat(F.lit(0), (length - real).cast("int"))
    mask = F.concat(ones, zeros) if side == "right" else F.concat(zeros, ones)
    return F.when(ids.isNotNull(), mask)


def find_subsequence(ids: Column, tag: list[int] = V.RESPONSE_MARKER_IDS) -> Column:
    """T8. One-based place of the last occurrence of `tag` in `ids`; null if there is none."""

    def starts_here(place: Column) -> Column:
        return reduce(and_, [F.get(ids, place - 1 + k) == F.lit(value) for k, value in enumerate(tag)])

    places = F.when(F.size(ids) >= len(tag), F.sequence(F.lit(1), F.size(ids)))
    return F.array_max(F.filter(places, starts_here))


def answer_labels(ids: Column, tag: list[int] = V.RESPONSE_MARKER_IDS) -> Column:
    """T9. The ids after the last marker; everything up to it, or the whole row without one, is ignored."""
    ignored = F.lit(V.IGNORED_LABEL)
    answer_from = F.coalesce(find_subsequence(ids, tag) + (len(tag) - 1), F.size(ids))
    return F.concat(
        F.array_repeat(ignored, answer_from.cast("int")),
        F.slice(ids, answer_from + 1, F.greatest(F.size(ids) - answer_from, F.lit(0))),
    )


def step_of(batch: Column, accumulation: int) -> Column:
    """F5. Optimizer step a batch belongs to when `accumulation` batches make one step."""
    return F.floor(batch / F.lit(accumulation)).cast("bigint")
