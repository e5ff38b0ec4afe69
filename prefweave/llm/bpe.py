"""Byte-pair encoding with forced boundaries, and decoding."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from prefweave.llm.columns import text_function

# Encoded words that a task keeps for reuse, in each of two generations, and fragments of longer words.
CACHED, CACHED_FRAGMENTS = 125_000, 25_000
# Fragments of up to so many bytes are merged without a heap.
SHORT = 64


class Encoder:
    """Encodes as the vocabulary file describes: a lower-casing BPE with word ends, over bytes.

    A pair of neighbouring bytes that stands inside no token can never be merged over, so the text is cut there for
    certain: each fragment between such cuts is encoded by itself, once, and the results are put side by side.
    """

    def __init__(self, described: str):
        told = json.loads(described)
        model = told["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.texts = {str(i): t for t, i in [*self.vocab.items(), *self.special.items()]}
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        # Latin letters need no tables: the same expression for them, in the standard library.
        self.latin_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
        self.letters = byte_letters()
        self.inside = {t[i : i + 2] for t in map(self._bare, self.vocab) for i in range(len(t) - 1)}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.fragments: dict[tuple[str, bool], list[str]] = {}
        self._library = None
        self._described = described

    def _bare(self, token: str) -> str:
        return token[: -len(self.end)] if self.end and token.endswith(self.end) else token

    def pieces(self, text: str) -> list[str]:
        """Words of a text, as strings of byte letters are made of them later."""
        if LATIN.fullmatch(text):
            # Such text is in normal form, and blanks of any kind and number part words alike.
            return self.latin_words.findall(text.lower())
        # Beyond Latin, versions of the tables of letters differ: the library that wrote the file splits.
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._described)
        library = self._library
        split = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        return [TRANSLATED + word for word, _ in split]

    def fragments_of(self, word: str) -> list[tuple[str, bool]]:
        """The word, in byte letters, cut at the pairs that no token holds; the flag says that it ends the word."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside]
        edges = [0, *cuts, len(word)]
        return [(word[a:b], b == len(word)) for a, b in zip(edges, edges[1:])]

    def encode_fragment(self, fragment: str, last: bool) -> list[str]:
        """Tokens of a fragment: the best-ranked pair is merged first, the leftmost of equals."""
        parts: list[str | None] = list(fragment)
        if last:
            parts[-1] += self.end
        return self._merge_short(parts) if len(parts) <= SHORT else self._merge_long(parts)

    def _merge_short(self, parts: list[str]) -> list[str]:
        """Look through the ranks of all pairs for each merge: fastest for words."""
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[str | None]) -> list[str]:
        """The same with a heap of pairs, for fragments of any length."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (parts[i], parts[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, *p))
            if before[i] >= 0 and (p := (parts[before[i]], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[p], before[i], *p))
        return [p for p in parts if p is not None]

    def encode_word(self, word: str) -> str:
        """The ids of the tokens, joined by spaces."""
        if word.startswith(TRANSLATED):
            spelt = word[len(TRANSLATED) :]
        else:
            spelt = "".join(map(self.letters.__getitem__, word.encode()))
        tokens: list[str] = []
        fragments = self.fragments_of(spelt)
        if len(fragments) == 1:  # kept as the word itself
            tokens, fragments = self.encode_fragment(*fragments[0]), []
        for fragment in fragments:
            found = self.fragments.get(fragment)
            if found is None:
                if len(self.fragments) >= CACHED_FRAGMENTS:
                    self.fragments.clear()
                found = self.fragments[fragment] = self.encode_fragment(*fragment)
            tokens += found
        vocab = self.vocab
        return " ".join([str(vocab[t]) for t in tokens if t in vocab])

    def encode(self, text: str) -> tuple[int, str]:
        """Number of tokens and the ids, joined by spaces. Special tokens in the text count as themselves."""
        ids = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                ids.append(str(self.special[part]))
                continue
            if len(self.known) >= CACHED:
                # Words that are still in use come back from the older generation; the others go with it.
                self.known, self.older = {}, self.known
            get, add = self.known.get, self._add
            ids += filter(None, [get(word) or add(word) for word in self.pieces(part)])
        joined = " ".join(ids)
        return joined.count(" ") + 1 if joined else 0, joined

    def _add(self, word: str) -> str:
        found = self.older.get(word)
        if found is None:
            found = self.encode_word(word)
        self.known[word] = found
        return found

    def decode(self, ids: str) -> str:
        """The texts of ids joined by spaces, special tokens included; the file names no decoder, so spaces join them."""
        return " ".join(map(self.texts.__getitem__, ids.split(" "))) if ids else ""


# Marks a word that is in byte letters already; the private-use character stands in no byte letter.
TRANSLATED = "\ue000"
# Text of ASCII and Latin letters up to U+017F, but for the dotted capital I, whose lower case is two characters, the
# digits and fractions that are numbers but no decimal digits, and blanks on which libraries differ.
LATIN = re.compile(r"[\x00-\x1b\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įĲ-ž]*")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in prints}
    letters.update({b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in letters)})
    return letters


def _coder(described: str) -> Callable:
    encoder = Encoder(described)

    def encode(texts: list[str]) -> list:
        found = [encoder.encode(t) for t in texts]
        return [pa.array([n for n, _ in found], pa.int64()), pa.array([ids for _, ids in found], pa.large_string())]

    return encode


def shipped_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, some megabytes whatever the corpus, as a broadcast variable."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encode_column(text: Column, vocabulary) -> Column:
    """`n_tokens` and `ids`, joined by spaces, of whole texts; null and empty texts have none."""
    types = {"n_tokens": pa.int64(), "ids": pa.large_string()}
    return text_function("n_tokens bigint, ids string", types, lambda: _coder(vocabulary.value))(text)


def decode_column(ids: Column, vocabulary) -> Column:
    """The text of ids joined by spaces; null reads as empty."""

    def make():
        encoder = Encoder(vocabulary.value)
        return lambda rows: [pa.array([encoder.decode(r) for r in rows], pa.large_string())]

    return text_function("text string", {"text": pa.large_string()}, make)(ids)["text"]


def round_trip_digests(text: Column, vocabulary) -> Column:
    """`n_tokens` and the SHA-256 of ids and of decoded text, worked out where the text lies: encode, then decode the ids."""
    import hashlib

    def make():
        encoder = Encoder(vocabulary.value)

        def work(texts: list[str]) -> list:
            rows = []
            for text in texts:
                n, ids = encoder.encode(text)
                decoded = encoder.decode(ids)
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            return [list(column) for column in zip(*rows)] if rows else [[], [], []]

        return work

    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return text_function("n_tokens bigint, ids_sha256 string, decoded_sha256 string", types, make)(text)
