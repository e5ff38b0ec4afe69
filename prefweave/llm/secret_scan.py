"""Secret scans: keyword prefilter, anchored expressions at the hits, embedded checksums."""

from __future__ import annotations

import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column

from prefweave.llm.columns import text_function

# Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Prefixes of tokens that end in six base-62 digits of the CRC-32 of the thirty characters before them.
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")


def base62(number: int, width: int) -> str:
    digits = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits


def checksum_holds(body: str) -> bool:
    """The last six of 36 characters are the checksum of the first thirty."""
    return base62(zlib.crc32(body[:30].encode()), 6) == body[30:]


def keyword_automaton() -> ahocorasick.Automaton:
    """Lower-case keywords, each with its length and the kind of expression to try at its start."""
    automaton = ahocorasick.Automaton()
    for word in ASSIGN_KEYWORDS:
        automaton.add_word(word, (len(word), "assign"))
    automaton.add_word("akia", (4, "access"))
    for prefix in CHECKED_PREFIXES:
        automaton.add_word(prefix, (4, "checked"))
    automaton.make_automaton()
    return automaton


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, ordered by start, then kind as listed."""
    # Lower-casing ASCII letters alone keeps the places of all characters.
    lowered = text.lower() if text.isascii() else text.encode().lower().decode()
    hits = [(end - size + 1, kind) for end, (size, kind) in automaton.iter(lowered)]
    spans, done = [], {"assign": 0, "access": 0, "checked": 0}
    for start, kind in sorted(hits):
        if start < done[kind]:
            continue
        found = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, start)
        if not found:
            continue
        done[kind] = found.end()
        if kind == "assign":
            if found.end() - found.start(1) >= 8:
                spans.append((start, kind, found.end()))
        elif kind == "access":
            if found.end() - start >= 16:
                spans.append((start, kind, found.end()))
        elif checksum_holds(found[1]):
            spans.append((start, CHECKED_PREFIXES[text[start : start + 4]], found.end()))
    spans += [(found.start(), "hex", found.end()) for found in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def _scanner():
    automaton = keyword_automaton()

    def scan(texts: list[str]) -> list[list]:
        found = [find_spans(t, automaton) for t in texts]
        return [
            [[kind for _, kind, _ in spans] for spans in found],
            [[start for start, _, _ in spans] for spans in found],
            [[end for _, _, end in spans] for spans in found],
        ]

    return scan


def secret_spans(text: Column) -> Column:
    """The secrets of a text as (kind, start, end) arrays, in code points, end exclusive, ordered by start, then kind.

    Kinds: `assign`, a keyword with a value of at least 8 characters; `access`, access key ids of at least 16 characters;
    `hex`, runs of at least 32 lower-case hexadecimal digits, which no keyword announces; `github` and `npm`, tokens whose
    last six characters are the checksum of the rest. Null and empty texts have no spans. Whole texts are read, one pass for
    the keywords and one for hexadecimal runs; the other expressions are tried at keyword hits only.
    """
    types = {"kind": pa.list_(pa.string()), "start": pa.list_(pa.int32()), "end": pa.list_(pa.int32())}
    return text_function("kind array<string>, start array<int>, end array<int>", types, _scanner)(text)
