"""Line dedup against brute force, and the pipeline against its stages worked out one by one in plain Python."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from prefweave.llm import line_dedup as D
from tests_llm_helpers import brute_components, brute_contamination, expected_digests

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _may int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "k", 1) for i, t, lang in rows], SCHEMA)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc d", max_size=40), st.text(alphabet="abc d", max_size=40), st.integers(0, 12))
def test_edit_distance(a, b, most):
    true, got = levenshtein(a, b), D.edit_distance(a, b, most)
    assert got == true if true <= most else got > most


def blocks_of(signature):
    """The blocks of a signature, each with its number."""
    return {(i, int(signature[i // 2]) >> 32 * (i % 2) & 0xFFFFFFFF) for i in range(D.BLOCKS)}


def bits_apart(a, b):
    return sum(int(x ^ y).bit_count() for x, y in zip(a, b))


def brute_lines(rows):
    """Groups of linked lines by comparing every pair, and what each row loses."""
    lines = [(d is None, d if d is not None else 0, r, at, line) for r, (d, t) in enumerate(rows) for at, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if D.normal_line(x[4])] if lines else []
    forms = sorted({D.normal_line(x[4]) for x in lines})
    _, sims, _ = D.line_signatures(forms) if forms else (0, [], 0)
    met = [blocks_of(x) for x in sims]
    label = {f: f for f in forms}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(forms):
        for j in range(i):
            if met[i] & met[j] and bits_apart(sims[i], sims[j]) <= D.MOST_BITS and D.alike(a, forms[j]):
                label[root(a)] = root(forms[j])
    first = {}
    for x in sorted(lines):
        first.setdefault(root(D.normal_line(x[4])), x[:4])
    lost = [[] for _ in rows]
    for x in sorted(lines):
        if first[root(D.normal_line(x[4]))] != x[:4]:
            lost[x[2]].append(x[3])
    return [(len(t.split("\n")) if t else 0, sorted(gone)) for (_, t), gone in zip(rows, lost)]


def test_lines_match_brute_force(spark):
    random.seed(8)
    vocabulary = ["w%s" % chr(97 + i % 26) * (1 + i % 3) for i in range(60)]
    bases = [" ".join(random.choices(vocabulary, k=40)) for _ in range(8)]

    def line():
        words = random.choice(bases).split(" ")
        for _ in range(random.randrange(3)):
            words[random.randrange(40)] = random.choice(vocabulary)
        return random.choice(["", "- ", "  "]) + " ".join(words).replace(" ", random.choice([" ", "  ", ", "]))

    rows = [(i, "\n".join(random.choice([line(), "", "...", "Page 12", "page 7"]) for _ in range(random.randrange(7)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, "Page 99\nonly here"), (3, rows[3][1]), (53, "Z" + "ä" * 3000 + "\nz" + "Ä" * 3000)]
    got = D.line_duplicates(table(spark, [(i, t, "x") for i, t in rows]).coalesce(1)).collect()
    wanted = sorted((str(d), n, lost) for (d, _), (n, lost) in zip(rows, brute_lines(rows)))
    assert sorted((str(r["doc_id"]), r["n_lines"], r["dropped"]) for r in got) == wanted
    assert any(lost for _, _, lost in wanted)
    assert D.line_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("ids", [[1, 2], [None, None], [7, 7]])
def test_lines_that_are_not_alike_stay_whatever_their_ids(spark, ids):
    words = ["word%s" % chr(97 + i) for i in range(16)]
    rows = [(ids[0], " ".join(words)), (ids[1], " ".join(reversed(words))), (3, " ".join(words) + " 1"), (3, " ".join(words) + " 2")]
    got = D.line_duplicates(table(spark, [(i, t, "x") for i, t in rows]).coalesce(1)).collect()
    wanted = sorted((str(d), n, lost) for (d, _), (n, lost) in zip(rows, brute_lines(rows)))
    assert sorted((str(r["doc_id"]), r["n_lines"], r["dropped"]) for r in got) == wanted


def test_lines_of_shared_ids_match_brute_force(spark):
    """A third of the rows without an id, a third under one id; and such rows cost no more."""
    random.seed(18)
    vocabulary = ["w%s" % chr(97 + i % 26) * (1 + i % 3) for i in range(60)]
    bases = [" ".join(random.choices(vocabulary, k=40)) for _ in range(10)]

    def line():
        words = random.choice(bases).split(" ")
        words[random.randrange(40)] = random.choice(vocabulary)
        return " ".join(words)

    rows = [((None, 7, 100 + i)[i % 3], "\n".join(line() for _ in range(random.randrange(1, 4)))) for i in range(45)]
    got = D.line_duplicates(table(spark, [(i, t, "x") for i, t in rows]).coalesce(1)).collect()
    wanted = sorted((str(d), n, lost) for (d, _), (n, lost) in zip(rows, brute_lines(rows)))
    assert sorted((str(r["doc_id"]), r["n_lines"], r["dropped"]) for r in got) == wanted


def test_lines_are_taken_out(spark):
    df = spark.createDataFrame([("a\nb\nc", [1]), ("a", [0]), ("", []), ("x\n\ny", [1])], "t string, d array<int>")
    got = [r[0] for r in df.select(D.without_lines(F.col("t"), F.col("d"))).collect()]
    assert got == ["a\nc", "", "", "x\ny"]


def test_alike_lines_share_a_key(spark):
    """One block that is the same, and lengths within the bound, leave a common key."""
    random.seed(9)
    rows = []
    for _ in range(200):
        blocks = [random.getrandbits(D.BLOCK_BITS) for _ in range(D.BLOCKS)]
        others, size = [random.getrandbits(D.BLOCK_BITS) for _ in blocks], random.randrange(5, 4000)
        same = random.randrange(D.BLOCKS)
        others[same] = blocks[same]
        packed = [side[i] | side[i + 1] << 32 for side in (blocks, others) for i in range(0, D.BLOCKS, 2)]
        rows.append((*packed, size, random.randrange(-(-size * 90 // 100), size + 1)))
    half = D.BLOCKS // 2
    df = spark.createDataFrame(rows, ", ".join(f"c{i} bigint" for i in range(2 * half)) + ", n int, m int")
    keys = lambda first, size: D.block_keys([F.col(f"c{first + i}") for i in range(half)], F.col(size))
    assert df.filter(~F.arrays_overlap(keys(0, "n"), keys(half, "m"))).count() == 0


def test_a_changed_word_leaves_blocks_as_they_were():
    random.seed(6)
    words = ["".join(random.choices("abdeginorst", k=6)) for _ in range(400)]
    lines = [random.sample(words, 30) for _ in range(200)]
    others = [line[:9] + [f"new{chr(97 + i % 26)}{chr(97 + i // 26)}"] + line[10:] for i, line in enumerate(lines)]
    sims = [D.line_signatures([" ".join(line) for line in side])[1] for side in (lines, others)]
    shared = [len(blocks_of(a) & blocks_of(b)) for a, b in zip(*sims)]
    # Neither word votes in a block with a chance of (11/16)^2.
    assert sum(map(bool, shared)) >= 0.97 * len(shared) and sum(shared) / len(shared) > 0.4 * D.BLOCKS


def test_signatures_in_steps(monkeypatch):
    """Many words are worked out in steps, each line by itself, with the same signatures; repeated words vote once."""
    random.seed(4)
    lines = [" ".join(random.choice("abcdefgh") * random.randrange(1, 4) for _ in range(random.randrange(0, 90))) for _ in range(60)]
    whole = D.line_signatures(lines)
    monkeypatch.setattr(D, "STEP_WORDS", 40)
    assert all((a == b).all() for a, b in zip(whole, D.line_signatures(lines)))
    assert [D.line_signatures([line])[1][0].tolist() for line in lines] == whole[1].tolist()
    assert D.line_signatures(["x y z"])[1].tolist() == D.line_signatures(["x y x z y"])[1].tolist()


def test_different_lines_seldom_meet():
    """Lines that have nothing to do with each other stay apart, however many they are."""
    random.seed(10)
    lines = [" ".join("%x" % random.getrandbits(40) for _ in range(12)) for _ in range(50_000)]
    sims = D.line_signatures([line.translate(str.maketrans("0123456789", "ghijklmnop")) for line in lines])[1]
    met = 0
    for i in range(D.BLOCKS):
        values = (sims[:, i // 2] >> 32 * (i % 2)) & 0xFFFFFFFF
        met += len(values) - len(set(values.tolist()))
    assert met < 100


def test_many_voters_are_counted_in_runs():
    """More words than a counter holds: the same blocks as by plain counting."""
    random.seed(11)
    hashes = D.mixed(np.arange(5000, dtype=np.uint64))
    counts = np.array([3, 254, 255, 256, 700, 1, 3531])
    wanted = [np.unpackbits(x.view(np.uint8).reshape(-1, 8)[:, :4], axis=1).sum(axis=0) for x in np.split(hashes, np.cumsum(counts)[:-1])]
    assert (D._ones(hashes, counts) == np.array(wanted)).all()


def test_alike_in_columns(spark):
    """The engine's distance for short lines and our own for long ones say the same."""
    random.seed(12)
    rows = [("", "a"), ("ä" * 10, "ä" * 9 + "b"), ("a" * 19, "a" * 17), ("a" * 20, "a" * 18), ("x", "x")]
    for size in (30, 200, 5000):
        for _ in range(20):
            a = "".join(random.choices("ab é", k=size))
            b = list(a)
            for _ in range(random.randrange(size // 6)):
                b[random.randrange(len(b))] = random.choice(["", "c", "ü", "ab"])
            rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", D._alike_column(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(r["c"] == D.alike(r["a"], r["b"]) for r in got) and len({r["c"] for r in got}) == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_recall_against_edit_similarity_alone(spark):
    """Of all pairs of lines that are alike by their edits, whatever their signatures, nine in ten have to meet."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    lines = sorted({D.normal_line(line) for (t,) in texts for line in (t or "").split("\n")} - {""}, key=len)
    _, sims, _ = D.line_signatures(lines)
    counts = [{c: line.count(c) for c in set(line)} for line in lines]
    alike = met = 0
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            b = lines[j]
            if 10 * len(a) < 9 * len(b):
                break
            # Each edit changes the counts of two letters at most.
            apart = sum(abs(counts[i].get(c, 0) - counts[j].get(c, 0)) for c in counts[i].keys() | counts[j].keys())
            if 5 * apart <= len(b) and D.alike(a, b):
                alike += 1
                met += bool(blocks_of(sims[i]) & blocks_of(sims[j])) and bits_apart(sims[i], sims[j]) <= D.MOST_BITS
    assert alike >= 30 and met >= 0.9 * alike, (met, alike)


def rows_for_pipeline():
    random.seed(12)
    vocabulary = ["".join(random.choices("abdeginorst", k=random.randrange(2, 8))) for _ in range(500)]
    draw = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, draw(30)) for i in range(4)]
    rows = [(i, draw(random.randrange(20, 120)), "en") for i in range(40)]
    rows += [(40, rows[0][1] + "  ", "en"), (41, rows[1][1], None), (42, rows[2][1] + " " + vocabulary[0], "en"), (43, draw(10) + " " + items[0][1], "en")]
    rows += [(44, draw(1500) + " " + items[1][1][:90], "en"), (45, None, "en"), (46, "12 $$", "en"), (46, "12 $$", "en"), (5, rows[5][1], "en")]
    rows += [(None, rows[6][1], "en"), (None, draw(50), "en"), (47, "", "fr"), (48, items[2][1], "en")]
    return rows, items


def test_pipeline_matches_its_parts(spark, tmp_path):
    rows, items = rows_for_pipeline()
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = [(i, t) for i, t, _ in rows if t and any(map(str.isalpha, t))]
    exact = {}
    for r, (d, t) in enumerate(docs):
        exact.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d is None, d or 0, r, (d, t)))
    docs = [min(g)[4] for g in sorted(exact.values(), key=lambda g: min(g)[3])]
    unique = [(k, t) for k, (_, t) in enumerate(sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)))]
    by_rank = sorted(docs, key=lambda x: (x[0] is None, x[0] or 0))
    docs = [by_rank[k] for k, _, least in brute_components(unique) if k == least]
    docs = [(d, t) for d, t in docs if not brute_contamination(t, items)[3]]
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, *expected_digests(t))) for d, t in docs)
    assert len(got) < len(rows) - 8


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and found.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_digest_helper_agrees_with_itself():
    assert expected_digests("")[1] == hashlib.sha256(b"").hexdigest()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_pipeline_over_a_driver_table(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() == got.select("doc_id").distinct().count() > 100
