"""Periodic runs of words: segments are split where words are too rare, and lags are scanned in what is left."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from prefweave.llm.columns import text_function
from prefweave.llm.words import mixed

# A run has at least this many words, and at least two periods.
LEAST_RUN = 12
# Rounds that split all segments at once; what still splits after them is cut one by one.
ROUNDS = 24
# Pairs of blocks that are compared at once.
PAIRS = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def _neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the word of each place stands the time before (or -1) and the next time (or the length)."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before, after = np.full(len(ids), -1), np.full(len(ids), len(ids))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _cut_one_by_one(before: np.ndarray, after: np.ndarray, start: int, stop: int) -> list[tuple[int, int]]:
    """The stable segments of one segment, looked through from both ends at once: n log n steps, however it splits."""
    before, after = before[start:stop].tolist(), after[start:stop].tolist()
    found, left = [], [(start, stop)]
    while left:
        low, high = left.pop()
        if high - low < LEAST_RUN:
            continue
        for i in range((high - low + 1) // 2):
            at = low + i
            if before[at - start] < low and after[at - start] >= high:
                break
            at = high - 1 - i
            if before[at - start] < low and after[at - start] >= high:
                break
        else:
            found.append((low, high))
            continue
        left += [(low, at), (at + 1, high)]
    return found


def stable_segments(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the segments of LEAST_RUN words or more in which every word occurs at least twice.

    A run of length l and period q holds each of its words at least floor(l / q) >= 2 times, so a word that its segment holds
    once is in no run: it parts the segment, whose parts are looked at again until none splits. `bounds` parts the texts.
    """
    before, after = _neighbours(ids)
    starts, stops = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    found = []
    for _ in range(ROUNDS):
        long = stops - starts >= LEAST_RUN
        starts, stops = starts[long], stops[long]
        if not len(starts):
            break
        sizes = stops - starts
        offsets = np.cumsum(sizes) - sizes
        segment = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(segment)) + (starts - offsets)[segment]
        kept = (before[at] >= starts[segment]) | (after[at] < stops[segment])
        whole = np.logical_and.reduceat(kept, offsets)
        found.append((starts[whole], stops[whole]))
        kept &= ~whole[segment]
        first, last = kept.copy(), kept.copy()
        joined = kept[1:] & kept[:-1] & (segment[1:] == segment[:-1])
        first[1:] &= ~joined
        last[:-1] &= ~joined
        starts, stops = at[first], at[last] + 1
    else:
        rest = [s for low, high in zip(starts.tolist(), stops.tolist()) for s in _cut_one_by_one(before, after, low, high)]
        if rest:
            found.append(tuple(np.array(rest, np.int64).T))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, stops = (np.concatenate(side) for side in zip(*found))
    order = np.argsort(starts)
    return starts[order], stops[order]


def _ramp(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every i, `counts[i]` rows: i, and a number from 0."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - (np.cumsum(counts) - counts)[of]


def _stretch(ids: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The places around `at`, between `low` and `high`, at which the word equals the one `lag` later."""
    start, step = at, 64
    while start > low:
        size = min(step, start - low)
        other = np.flatnonzero(ids[start - size : start] != ids[start - size + lag : start + lag])
        if len(other):
            start = start - size + int(other[-1]) + 1
            break
        start, step = start - size, step * 2
    end, step = at, 64
    while end + lag < high:
        size = min(step, high - lag - end)
        other = np.flatnonzero(ids[end : end + size] != ids[end + lag : end + lag + size])
        if len(other):
            end += int(other[0])
            break
        end, step = end + size, step * 2
    return start, end


def scan_lags(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run inside the segments.

    A run of period q gives a stretch of max(LEAST_RUN, 2q) - q places that equal the place q later. Such a stretch holds a
    whole block of half its length among the blocks laid end to end from the start of the segment, so for every lag only
    these blocks are compared, by sums that stand for them: some 2 n log n comparisons in a segment of n words. Blocks that
    agree are then widened word by word. A stretch inside a run of a divisor of its lag is that run once more.
    """
    sizes = stops - starts
    of, lag = _ramp(sizes // 2)
    lag += 1
    block = (np.maximum(LEAST_RUN, 2 * lag) - lag + 1) // 2
    counts = (sizes[of] - lag) // block
    total = np.cumsum(counts)
    powers = np.full(len(ids) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    runs: list[tuple[int, int, int]] = []
    segment, last_lag, last_end = -1, 0, 0
    known: dict[int, tuple[list[int], list[int]]] = {}
    divisors: list[tuple[list[int], list[int]]] = []
    done = 0
    while done < len(of):
        before = total[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        which, k = _ramp(counts[done:stop])
        which += done
        at = starts[of[which]] + k * block[which]
        likely = ids[at] == ids[at + lag[which]]
        which, at = which[likely], at[likely]
        q, b = lag[which], block[which]
        likely = (sums[at + b] - sums[at]) * powers[q] == sums[at + q + b] - sums[at + q]
        for place, row in zip(at[likely].tolist(), which[likely].tolist()):
            period, size = int(lag[row]), int(block[row])
            if of[row] != segment:
                segment, last_lag, known = of[row], 0, {}
            if period != last_lag:
                last_lag, last_end = period, -1
                divisors = [known[d] for d in known if period % d == 0]
            if place < last_end:
                continue
            inside = False
            for begins, ends in divisors:
                i = bisect_right(begins, place) - 1
                inside = inside or (i >= 0 and ends[i] >= place + period + size)
            if inside:
                continue
            begin, end = _stretch(ids, place, period, int(starts[segment]), int(stops[segment]))
            last_end = end
            if end - begin + period >= max(LEAST_RUN, 2 * period):
                runs.append((begin, end - begin + period, period))
                begins, ends = known.setdefault(period, ([], []))
                begins.append(begin)
                ends.append(end + period)
        done = stop
    return runs


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For every text, given as its words, the (start, length, period) of its runs by start, then period."""
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in texts], dtype=np.int64)])
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64, int(bounds[-1]))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in scan_lags(ids, *stable_segments(ids, bounds)):
        text = int(np.searchsorted(bounds, start, side="right")) - 1
        found[text].append((start - int(bounds[text]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def _finder():
    def work(texts: list[str]) -> list:
        # Blanks that part words are those of ASCII: the bytes \x20 and \x09 to \x0D.
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        runs = find_runs(words)
        kept = [b" ".join(collapsed_words(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, runs)]
        return [[len(w) for w in words], runs, kept]

    return work


def periodic_runs(text: Column) -> Column:
    """Struct of `n_words`, `runs` (start, length, period, in words from 0; by start, then period) and the `collapsed` text.

    A run is a stretch of words with smallest period q and a length of at least max(12, 2q) that no neighbouring word
    extends. `collapsed` has the words that no run holds after its first q words, joined by one blank. Null and empty texts
    have no words, no runs and an empty collapsed text. Whole texts are looked at, rows never leave their partition.
    """
    runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    types = {"n_words": pa.int64(), "runs": runs, "collapsed": pa.string()}
    ddl = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return text_function(ddl, types, _finder)(text)
