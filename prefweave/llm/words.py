"""Words of many texts at once, as places in their UTF-8 bytes and as 64-bit hashes."""

from __future__ import annotations

import numpy as np

# Fixed values: [\x20\x09-\x0D] parts words of the first kind; those of the second are made of [0-9a-z] and all characters
# above ASCII, whose bytes are all above 0x7F.
_ALL = np.arange(256)
NOT_BLANK = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
UPPER = (_ALL >= 0x41) & (_ALL <= 0x5A)
LOWERED = np.where(UPPER, _ALL + 0x20, _ALL).astype(np.uint8)
ALPHANUMERIC = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | UPPER | (_ALL >= 0x80)

# Stated constants: odd multipliers, and a seeded table of random values for the bytes.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


# Bytes whose words are hashed at once; a longer single word is hashed by itself.
HASHED_BYTES = 1 << 19


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _kept:
        _kept.clear()
        _kept[size] = _new_powers(size)
    return _kept[size]


def _new_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.full(size, _BASE, np.uint64)
    inverse = np.full(size, _BASE_INVERSE, np.uint64)
    ones[0] = inverse[0] = 1
    return np.cumprod(ones), np.cumprod(inverse)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line feed after each, and where each text starts."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8) if encoded else np.zeros(0, np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes)])


def word_places(data: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word. Words never cross texts: the line feed between them belongs to none."""
    inside = np.concatenate([[False], in_word[data]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case, worked out block by block so that scratch arrays stay small."""
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + HASHED_BYTES, side="right")))
        block = data[low : ends[stop - 1]]
        powers, inverse = _powers(1 << max(20, int(len(block)).bit_length()))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTES[LOWERED[block]] * powers[: len(block)], out=sums[1:])
        first, last = starts[at:stop] - low, ends[at:stop] - low
        found[at:stop] = mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
        at = stop
    return found


def count_words(texts: list[str], in_word: np.ndarray = ALPHANUMERIC) -> np.ndarray:
    """Number of words of each text."""
    data, offsets = joined(texts)
    starts, _ = word_places(data, in_word)
    return np.diff(np.searchsorted(starts, offsets))
