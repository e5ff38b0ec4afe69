"""Brute-force forms that several tests share."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from test_documents import brute_components, brute_contamination  # noqa: F401

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected_digests(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    joined = " ".join(map(str, ids))
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
