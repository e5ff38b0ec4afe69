"""Scans of texts against plain expressions run over the whole text."""

import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefweave.llm import license_scan as L
from prefweave.llm import pii as P
from prefweave.llm import secret_scan as S
from prefweave.llm.columns import slices
from prefweave.llm.queries import QUERIES

EDGES = "doc_id bigint, text string, kind string, start int, found string, spans string"
AUTOMATON = S.keyword_automaton()


def edge_table(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1, "f", "s") for i, t in texts], EDGES)


def brute_secrets(text):
    """The base kinds by their expressions alone, without the prefilter."""
    spans = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if len(m[2]) >= 8:
            spans.append((m.start(), "assign", m.end()))
    spans += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda s: (s[0], S.KINDS.index(s[1])))


PIECES = ["password", "PassWd", "ſecret", "secret", "TOKEN", "api_key", "apiKey", "=", ":", " ", '"', "'", "abcdefgh", "0123456789abcdef", "AKIA", "Z9", "ABCDEFGHIJKL", "é", "\n", "toKen", "x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_secrets_match_plain_expressions(text):
    assert [s for s in S.find_spans(text, AUTOMATON) if s[1] in ("assign", "access", "hex")] == brute_secrets(text)


def test_checksums_decide():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = body + S.base62(zlib.crc32(body.encode()), 6)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    text = f"use ghp_{good} or ghp_{bad}, npm_{good}; GHP_{good} ghp_{good}x"
    assert [(k, text[a:b]) for a, k, b in S.find_spans(text, AUTOMATON)] == [("github", f"ghp_{good}"), ("npm", f"npm_{good}")]


def test_secret_column_of_edge_rows(spark):
    long = "word " * 300_000 + "token=abcdefgh12"
    texts = [(1, None), (2, ""), (3, long), (None, "secret: 12345678"), (4, "secret: 12345678"), (4, "secret: 12345678")]
    got = edge_table(spark, texts).select("doc_id", S.secret_spans(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    assert [r["kind"] for r in got] == [[], [], ["assign"], ["assign"], ["assign"], ["assign"]]
    assert got[2]["start"] == [1_500_000] and got[3]["end"] == [16]
    assert edge_table(spark, []).select(S.secret_spans(F.col("text")).alias("s")).count() == 0


def brute_pii(text):
    spans = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and P.luhn(digits):
            spans.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), "phone", m.end()))
    return sorted(spans, key=lambda s: (s[0], P.KINDS.index(s[1])))


PII_PIECES = ["a", "b.c", "@", "@x.com", ".", "-", "_", "+", "1", "22", "255", "256", "007", "4111111111111111", "4111 1111 1111 1111", " ", "(", ")", "+49 30", "555-0199", "é", "[at]", "[dot]", "mail"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PII_PIECES), max_size=25).map("".join))
def test_personal_data_matches_plain_expressions(text):
    assert [(a, k, b) for a, k, b, strict in P.candidates(text) if strict] == brute_pii(text)


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" * 50_000, "a@" * 50_000, "1 " * 100_000):
        P.candidates(text)


def test_labelers_are_told_apart():
    """A labeler that is right nine times in ten is found more reliable than one that guesses."""
    random.seed(2)
    counts = {}
    for _ in range(4000):
        real = random.random() < 0.6
        vote = tuple(int(real if random.random() < right else not real) for right in (0.95, 0.9, 0.9, 0.55))
        counts[vote] = counts.get(vote, 0) + 1
    import numpy as np

    rows = np.array(list(counts))
    chance, right = P.estimate_reliabilities(rows, np.array(list(counts.values()), float))
    assert right[0].mean() > 0.9 and right[1].mean() > 0.85 and right[3].mean() < 0.65
    assert chance[[tuple(r) for r in rows].index((1, 1, 1, 1))] > 0.99


def test_loose_spans_are_added_and_strict_ones_stay(spark):
    texts = [(i, f"please mail to bob{i}@site{i}.com or phone +49 30 555 01{i:02d}") for i in range(40)]
    texts += [(100 + i, f"contact by mail: ann{i} [at] host{i} [dot] com") for i in range(10)]
    texts += [(200, None), (201, ""), (None, "mail x@y.org"), (202, "+1")]
    found = edge_table(spark, texts).select("doc_id", P.candidate_spans(F.col("text")).alias("c")).select("doc_id", "c.*")
    model = P.learn_spans(found)
    got = {r["doc_id"]: r["spans"] for r in P.decided(found, model).collect()}
    assert all([s["kind"] for s in got[i]] == ["email", "phone"] for i in range(40))
    assert all([(s["kind"], s["strict"]) for s in got[100 + i]] == [("email", False)] for i in range(10))
    assert got[200] == got[201] == got[202] == [] and len(got[None]) == 1
    none = edge_table(spark, []).select("doc_id", P.candidate_spans(F.col("text")).alias("c")).select("doc_id", "c.*")
    assert P.decided(none, P.learn_spans(none)).count() == 0


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places)


WORDS = ["GNU", "general", "Public", "license", "Apache", "cc", "CC", "by", "by-nc", "MIT", "mit", "licenses", "é", "4.0", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=25).map(" ".join))
def test_phrases_match_brute_force(text):
    lowered = text.encode().lower().decode()
    n, places = brute_phrases(text)
    assert L.phrase_places(lowered) == places
    assert L.count_words([text])[0] == n


def test_one_seed_survives_every_allowed_edit():
    """Notices with random edits, as many as allowed, are found where they stand."""
    import regex

    random.seed(4)
    automaton = L._automaton()
    patterns = {n: regex.compile(rf"(?b:{regex.escape(n)}){{e<={L.edits_of(n)}}}") for n in L.NOTICES}
    for notice, label in L.NOTICES.items():
        for _ in range(20):
            changed = list(notice)
            for _ in range(L.edits_of(notice)):
                at = random.randrange(1, len(changed) - 1)
                random.choice([lambda: changed.insert(at, "q"), lambda: changed.pop(at), lambda: changed.__setitem__(at, "q")])()
            text = "some words before " + "".join(changed) + " and after"
            spans = L.notice_spans(text, automaton, patterns)
            assert any(found == label and a <= 20 and b >= len(text) - 12 for a, b, found, _ in spans), (notice, text)
        assert not L.notice_spans("nothing of the kind, only words", automaton, patterns)


def test_touching_notices_are_all_found():
    """Copies with different numbers of edits side by side, in every order: each is reported where it stands."""
    import regex

    automaton = L._automaton()
    patterns = {n: regex.compile(rf"(?b:{regex.escape(n)}){{e<={L.edits_of(n)}}}") for n in L.NOTICES}
    random.seed(6)
    copies = ["released under the mit license", "releasd under the mit license", "released undr the mit license", "relxased under the mit lixense"]
    edits = [0, 1, 1, 2]
    for joint in ("\n", " ", ". "):
        for _ in range(40):
            picks = [random.randrange(4) for _ in range(random.randrange(2, 9))]
            text, wanted = "", []
            for k in picks:
                wanted.append((len(text), len(text) + len(copies[k]), "mit", 1 - edits[k] / 30))
                text += copies[k] + joint
            assert L.notice_spans(text, automaton, patterns) == wanted


def test_license_column_of_edge_rows(spark):
    texts = [(1, None), (2, ""), (3, "x " * 200_000 + "MIT License"), (None, "cc by"), (4, "Licensed under the Apache Licence, Version 2.0"), (4, "by cc")]
    got = edge_table(spark, texts).select("doc_id", L.license_scan(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["labels"]) for r in got] == [
        (0, 0, None, ""), (0, 0, None, ""), (200_002, 1, 200_000, "mit"), (2, 1, 0, "cc-by"), (8, 0, None, "apache-2.0"), (2, 0, None, ""),
    ]
    assert 0 < got[4]["score"] < 1 and got[3]["score"] == 1.0 and got[0]["score"] == 0.0


def test_slices_hold_every_text():
    import pyarrow as pa

    texts = pa.array([None, "a" * 10, "", "b" * 300, "c", None])
    parts = [p.to_pylist() for p in slices(texts, 20)]
    assert [t for p in parts for t in p] == texts.to_pylist() and len(parts) == 3


def test_queries_over_a_driver_table(spark):
    """The registered queries against the plain expressions, document by document."""
    import hashlib
    import os

    import pytest

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def digest(spans):
        return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()

    for r in QUERIES["op4_secret_scan"](spark, sf).collect():
        spans = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(spans) and r["n_hex"] == sum(k == "hex" for _, k, _ in spans)
    for r in QUERIES["op6_pii"](spark, sf).collect():
        spans = brute_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(spans) and r["n_card"] == sum(k == "card" for _, k, _ in spans)
    for r in QUERIES["op7_license_scan"](spark, sf).collect():
        n, places = brute_phrases(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
