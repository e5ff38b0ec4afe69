"""License scans: phrases word by word, and short notices with a bounded number of edits."""

from __future__ import annotations

import bisect
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column

from prefweave.llm.columns import text_function
from prefweave.llm.words import count_words

# The phrases whose words must stand side by side, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices in lower case, with their labels.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "licensed under the gnu general public license, version 3": "gpl-3.0",
    "licensed under the gnu general public license, version 2": "gpl-2.0",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the mozilla public license": "mpl",
    "released under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms, with or without modification": "bsd",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# Edits (inserted, deleted or changed characters) that a notice may have: one for every so many of its characters.
CHARS_PER_EDIT = 15

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def edits_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def seeds_of(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): with k edits allowed, one of k + 1 pieces is left untouched."""
    cuts = [round(i * len(notice) / (edits_of(notice) + 1)) for i in range(edits_of(notice) + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def _automaton() -> ahocorasick.Automaton:
    places: dict[str, list[tuple[str, int]]] = {}
    for notice in NOTICES:
        for offset, seed in seeds_of(notice):
            places.setdefault(seed, []).append((notice, offset))
    automaton = ahocorasick.Automaton()
    for seed, of in places.items():
        automaton.add_word(seed, (len(seed), of))
    automaton.make_automaton()
    return automaton


def best_first(lowered: str, windows: set[tuple[int, int]], pattern, shortest: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of matches inside the windows that do not overlap: those with fewest edits first, then the leftmost.

    Where a better match covers a part of a window's best one, what is left of the window on either side is searched again,
    so no match is lost to a better neighbour.
    """
    heap: list[tuple[int, int, int, int, int]] = []

    def look(low: int, high: int) -> None:
        if high - low >= shortest and (found := pattern.search(lowered, low, high)):
            heapq.heappush(heap, (sum(found.fuzzy_counts), found.start(), found.end(), low, high))

    for low, high in windows:
        look(low, min(high, len(lowered)))
    taken: list[tuple[int, int, int]] = []
    while heap:
        edits, start, end, low, high = heapq.heappop(heap)
        at = bisect.bisect_left(taken, (end,))
        if at and taken[at - 1][1] > start:
            look(low, min(high, taken[at - 1][0]))
            look(max(low, taken[at - 1][1]), high)
        else:
            taken.insert(at, (start, end, edits))
    return taken


def notice_spans(lowered: str, automaton, patterns) -> list[tuple[int, int, str, float]]:
    """(start, end, label, similarity) of every notice found with at most its number of edits."""
    windows: dict[str, set[tuple[int, int]]] = {}
    for last, (size, of) in automaton.iter(lowered):
        start = last - size + 1
        for notice, offset in of:
            slack = edits_of(notice)
            low, high = max(0, start - offset - slack), start - offset + len(notice) + slack
            windows.setdefault(notice, set()).add((low, high))
    spans = []
    for notice, around in windows.items():
        for start, end, edits in best_first(lowered, around, patterns[notice], len(notice) - edits_of(notice)):
            spans.append((start, end, NOTICES[notice], 1 - edits / len(notice)))
    return sorted(spans)


def phrase_places(lowered: str) -> list[tuple[int, str]]:
    """(word index, label) of every place where the words of a phrase stand side by side."""
    if not any(p.split()[0] in lowered for p in PHRASES):
        return []
    words = WORD.findall(lowered)
    places = []
    for phrase, label in PHRASES.items():
        wanted = phrase.split()
        if not all(w in lowered for w in wanted):
            continue
        at = -1
        while True:
            try:
                at = words.index(wanted[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(wanted)] == wanted:
                places.append((at, label))
    return sorted(places)


def _scanner():
    automaton = _automaton()
    patterns = {n: regex.compile(rf"(?b:{regex.escape(n)}){{e<={edits_of(n)}}}") for n in NOTICES}

    def scan(texts: list[str]) -> list:
        counts = count_words(texts)
        columns: list[list] = [[] for _ in range(8)]
        for text in texts:
            lowered = text.lower() if text.isascii() else text.encode().lower().decode()
            places = phrase_places(lowered)
            spans = notice_spans(lowered, automaton, patterns)
            base = sorted({label for _, label in places})
            row = (
                len(places),
                places[0][0] if places else None,
                places[-1][0] if places else None,
                ",".join(base),
                ",".join(sorted({*base, *(label for _, _, label, _ in spans)})),
                1.0 if places else max((s for _, _, _, s in spans), default=0.0),
                [f"{label}:{start}:{end}" for start, end, label, _ in spans],
                [s for _, _, _, s in spans],
            )
            for column, value in zip(columns, row):
                column.append(value)
        return [np.asarray(counts, np.int64), *columns]

    return scan


def license_scan(text: Column) -> Column:
    """What a text says about its licence.

    `n_words`; `n_base`, `first_word`, `last_word`: number, first and last word index of the places of PHRASES; `base_labels`
    and `labels`: distinct labels of the phrases, and with those of the notices, sorted and comma-joined; `score`: 1 if a
    phrase stands there, else the similarity of the best notice, else 0; `spans` (label:start:end in code points) and their
    `similarity`. Null and empty texts have no words and score 0.

    A notice may differ by one edit in every CHARS_PER_EDIT characters. Cut into one piece more than it may have edits, one
    piece is left whole in every match; those pieces are searched all at once, and bounded-error matching decides in the
    windows around them. Of matches of a notice that overlap, that with fewest edits counts, then the leftmost.
    """
    types = {
        "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
        "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
        "spans": pa.list_(pa.string()), "similarity": pa.list_(pa.float64()),
    }
    ddl = (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<string>, similarity array<double>"
    )
    return text_function(ddl, types, _scanner)(text)
