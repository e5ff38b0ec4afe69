"""Operators on whole documents against brute force: edge rows, hot groups, and the driver's tables against SQL."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from prefweave.llm import linking
from prefweave.llm import near_dedup as N
from prefweave.llm.components import components
from prefweave.llm.decontaminate import contamination
from prefweave.llm.exact_dedup import exact_duplicates
from prefweave.llm.near_dedup import estimated_similarity, near_duplicates
from prefweave.llm.oracles import ORACLES
from prefweave.llm.queries import QUERIES
from prefweave.llm.sieve import bitmap_of, sifted, without

SCHEMA = "doc_id bigint, text string, kept string, _id string, node string, n bigint, label string, found string, _bits int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", None, 1, None, "z", 0) for i, t in rows], SCHEMA)


def sets_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [sets_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = least.get(root(i))
        least[root(i)] = doc if known is None else known if doc is None else min(known, doc)
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)]


def near_copies(seed, groups=6, copies=8, words=60, edits=5):
    random.seed(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for _ in range(groups):
        base = random.choices(vocabulary, k=words)
        for _ in range(copies):
            copy = list(base)
            for _ in range(random.randrange(edits)):
                copy[random.randrange(words)] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    random.shuffle(rows)
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_copies(1)
    got = near_duplicates(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted((d, n, c, d == c) for d, n, c in brute_components(rows))


def test_near_duplicates_of_edge_rows(spark):
    long = " ".join(f"v{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "two one"), (None, "one two"), (None, "alone here"), (7, "a b c d e"),
        (7, "a b c d e"), (8, "x y z u v w"), (8, "completely other text than before"), (9, long), (10, long + " end"), (11, "à É x y z"), (12, "à é x y z"),
    ]
    got = near_duplicates(table(spark, rows)).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(brute_components(rows), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_duplicates(table(spark, [])).count() == 0


def test_rows_without_ids_cost_no_more(spark):
    """Texts are fetched by id and text: rows that share an id, or have none, are no group of their own."""
    import time

    rows = near_copies(21, groups=500, copies=4, words=40)
    seconds = []
    for ids in (lambda i: i, lambda i: None, lambda i: 7 if i % 2 else None):
        started = time.perf_counter()
        got = near_duplicates(table(spark, [(ids(i), t) for i, t in rows])).count()
        seconds.append(time.perf_counter() - started)
        assert got == len(rows)
    assert max(seconds[1:]) < 2 * seconds[0] + 5


def test_remaining_pairs_connect_what_stars_miss(spark, monkeypatch):
    """Chains: neighbours are alike, ends are not, and chunks are tiny."""
    monkeypatch.setattr(linking, "CHUNK", 2)
    words = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(14)]
    got = near_duplicates(table(spark, rows)).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(brute_components(rows))
    assert {r["component_id"] for r in got} == {0}


def test_linked_finds_every_link_between_parts(spark, monkeypatch):
    """Members of one group; links are given pairs, so that nothing depends on hashing."""
    monkeypatch.setattr(linking, "CHUNK", 3)
    random.seed(5)
    n = 24
    true = {(a, b) for a in range(n) for b in range(a) if random.random() < 0.06}
    node = lambda i: f"n{i:02d}"
    keys = [[7, 8] if i % 5 == 0 else [7] for i in range(n)]
    nodes = spark.createDataFrame([(node(i), keys[i], i) for i in range(n)], "node string, keys array<bigint>, i int")
    links = spark.createDataFrame([(node(a), node(b)) for a, b in true], "a string, b string")
    labels, _ = linking.linked(nodes, lambda x, y: F.lit(True), lambda pairs: pairs.join(links, ["a", "b"]))
    got = {r["node"]: r["label"] for r in labels.collect()}
    label = list(range(n))
    for _ in range(n):
        for a, b in true:
            label[a] = label[b] = min(label[a], label[b])
    assert {node(i): node(label[i]) for i in range(n) if any(i in p for p in true)} == got


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 300), (201, 200)]
    got = dict(components(spark.createDataFrame(links, "a int, b int")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_odd_bits_estimate_similarity():
    assert abs(estimated_similarity(0) - 1) < 1e-9
    assert abs(estimated_similarity(128 * (1 - (1 - 2 / 256) ** 64)) - 0.75) < 0.01


def test_sketches_keep_pairs_at_the_threshold():
    """Sets at 0.75 differ by far fewer odd bits than the bounds allow, at either size of sketch."""
    rng = np.random.default_rng(6)
    kinds = ((N.MULTIPLIERS, N.SKETCH_BITS, N.MOST_ODD_BITS), (N.SHARP_MULTIPLIERS, N.SHARP_BITS, N.SHARP_MOST_ODD_BITS))
    for multipliers, bits, most in kinds:
        odd = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 64, 400, np.uint64)
            values = np.concatenate([pool[:350], pool[50:]])
            sketches = N.odd_sketches(N.signatures(values, np.array([0, 350]), multipliers), bits)
            odd.append(int(np.bitwise_count(sketches[0] ^ sketches[1]).sum()))
        assert np.mean(odd) + 5 * np.std(odd) < most * 1.08
        assert max(odd) < most
        assert abs(N.estimated_similarity(np.mean(odd), len(multipliers), bits) - 0.75) < 0.03


def test_sieve_lets_all_keys_through(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 11 > 0, F.col("id")).alias("k"))
    wanted = rows.filter("id % 7 = 0").select("k")
    passed = sifted(rows, F.col("k"), bitmap_of(wanted, "k"))
    assert rows.filter("id % 7 = 0 and k is not null").select("k").exceptAll(passed.select("k")).count() == 0
    assert passed.count() < 1500
    assert sorted(r["id"] for r in without(rows, F.col("k"), wanted, "k").collect()) == [
        i for i in range(5000) if i % 11 == 0 or i % 7
    ]


def test_exact_duplicates_of_edge_rows(spark):
    rows = [
        (5, "a b"), (3, "ab"), (4, "a  b"), (2, "a\tb"), (9, None), (8, ""), (7, " \x0b"), (1, "abc"), (6, "a\x85b"), (None, "zz"), (10, "zz"),
        (11, "q q"), (11, "q q"), (12, "x" * 300 + "1"), (13, "x" * 300 + "2"), (14, "x" * 300 + " 1"), (None, None),
    ]
    got = exact_duplicates(table(spark, rows), carry={"t": F.col("text")}).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d, t))
    assert len(got) == len(rows)
    for r in got:
        group = sorted(groups[re.sub(r"[\x20\x09-\x0D]", "", r["t"] or "")], key=lambda g: g[:2] + (g[2] or 0,))
        assert (r["keep_id"], r["group_size"]) == (group[0][2], len(group)), r
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_duplicates(table(spark, [])).count() == 0


def test_exact_dedup_stays_native(spark, plan):
    assert not re.search("Python|Arrow|Pandas", plan(exact_duplicates(table(spark, [(1, "a"), (2, "a")]))))


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_contamination(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, other in items:
        own = words_of(other)
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1) if size else ():
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination_matches_brute_force(spark, monkeypatch, block_bytes):
    from prefweave.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    random.seed(3)
    vocabulary = [f"k{i}" for i in range(25)] + ["Été", "ß", "9"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([3, 12, 13, 14, 40])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, " .,; "), (None, "k1 k2"), (None, items[2][1] + " k9 k8"), (None, "k1 k2"), (3, items[3][1]), (23, items[0][1].upper())]
    rows = []
    for i in range(60):
        words = random.choices(vocabulary + ["other"], k=random.randrange(80))
        for _ in range(random.randrange(3)):
            own = words_of(random.choice(items)[1])
            at = random.randrange(len(words) + 1)
            words[at:at] = own
        rows.append((i, random.choice([" ", ", ", "\n"]).join(words)))
    rows += [(100, None), (101, ""), (102, "..."), (None, items[0][1]), (7, rows[7][1]), (103, items[1][1] * 1), (104, "zz " * 50_000 + items[2][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    told = contamination(table(spark, rows), benchmark, name="told", block_bytes=block_bytes)
    got = told.select("doc_id", "text", "told.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute_contamination(r["text"], items)


def test_items_without_an_id_are_searched(spark):
    """Also where no item has one: their windows are hit, and the list of ids stays empty."""
    benchmark = spark.createDataFrame([(None, "a b c"), (None, None)], "item_id bigint, text string")
    got = contamination(table(spark, [(1, "x a b c y"), (2, "a b")]), benchmark).select("found.*").collect()
    assert [tuple(r) for r in got] == [(5, 3, [], True), (2, 0, [], False)]


def test_contamination_without_rows(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    got = contamination(table(spark, [(1, "a b c"), (2, None)]), empty).select("found.*").collect()
    assert [tuple(r) for r in got] == [(3, 0, [], False), (0, 0, [], False)]
    assert contamination(table(spark, []), empty).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert difference(QUERIES[name](spark, sf).toPandas(), connect(sf).execute(ORACLES[name]).df()) is None


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
