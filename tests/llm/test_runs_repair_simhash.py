"""Periodic runs, conversation repair and SimHash components against brute force."""

import hashlib
import heapq
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefweave.llm import conversations as C
from prefweave.llm import periodic_runs as P
from prefweave.llm import simhash_dedup as S
from prefweave.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, f bigint, label string, _id string, key int, runs string, n int, w string, _least int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "l", "i", 2, "r", 3, "w", 4) for i, t in rows], DOCS)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute_runs(words):
    """Every maximal stretch of one period, its smallest, word by word."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(12, 2 * q):
                stretch = words[at : at + length]
                if all(stretch[d:] != stretch[:-d] for d in range(1, q)):
                    found.append((at, length, q))
            at = max(end, at + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_brute_runs_by_hand():
    assert brute_runs(list("abababababab")) == [(0, 12, 2)]
    assert brute_runs(list("xaaaaaaaaaaaay")) == [(1, 12, 1)]
    assert brute_runs(list("abcdefabcde")) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=14).flatmap(lambda b: st.integers(1, 4).map(lambda k: b * k)), max_size=6))
def test_runs_match_brute_force(blocks):
    words = [w.encode() for b in blocks for w in b]
    runs = P.find_runs([words, [], words[:5], words])
    assert runs == [brute_runs(words), [], [], brute_runs(words)]
    assert P.collapsed_words(words, runs[0]) == brute_collapsed(words, runs[0])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 4), st.integers(0, 160))
def test_runs_of_small_alphabets(seed, letters, size):
    random.seed(seed)
    words = [bytes([97 + random.randrange(letters)]) for _ in range(size)]
    assert P.find_runs([words]) == [brute_runs(words)]


def test_segments_are_the_same_however_they_are_cut(monkeypatch):
    random.seed(5)
    ids = np.array([random.randrange(40) for _ in range(300)] + [random.randrange(500) for _ in range(300)])
    bounds = np.array([0, 250, 250, 600])
    whole = [side.tolist() for side in P.stable_segments(ids, bounds)]
    monkeypatch.setattr(P, "ROUNDS", 1)
    assert [side.tolist() for side in P.stable_segments(ids, bounds)] == whole
    monkeypatch.setattr(P, "PAIRS", 7)
    words = [b"w%d" % i for i in ids[:250] % 5] * 2
    assert P.find_runs([words]) == [brute_runs(words)]


def planted(doc, text):
    words, h = split(text), zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_runs(doc, text):
    words = planted(doc, text)
    runs = brute_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (doc, len(runs), *first, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(brute_collapsed(words, runs))))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_query(spark, tmp_path):
    random.seed(3)
    draw = lambda n: " ".join("w%d" % random.randrange(30) for _ in range(n))
    rows = [(i, draw(random.randrange(0, 120))) for i in range(60)]
    rows += [(None, None), (None, "a " * 13), (7, None), (7, ""), (7, " \t\n\x0b\f\r "), (8, "Ä b c " * 9), (9, "x\x1cy " * 20 + draw(700))]
    rows += [(10**12 + i, "\n".join([draw(9)] * 3)) for i in range(40)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == RUN_COLUMNS
    wanted = [expected_runs(i, t) for i, t in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
    assert sum(w[1] for w in wanted) > 40
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["op11_periodic_runs"](spark, str(tmp_path / "none")).count() == 0


def brute_repair(rows):
    """rows of (role, text) in order: counts, the cheapest audit by a search over (cost, audit), and the repaired rows."""
    seen, kinds = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\x0b\f\r")
        kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, settled = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in settled:
            continue
        settled.add((i, state))
        steps = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for to, name in (("u", "user"), ("a", "assistant")):
            if to in steps:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*out, (name, ""))))
                if i < len(rows) and kinds[i] in ("", "truncated"):
                    extra = 5 * (kinds[i] == "truncated")
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, to, (*out, (name, rows[i][1]))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if kinds[i] in ("", "truncated") and rows[i][0] and rows[i][0][0] in steps:
                heapq.heappush(heap, (cost + 5 * (kinds[i] == "truncated"), audit + "K", i + 1, rows[i][0][0], (*out, rows[i])))
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return [kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, out


def expected_repair(table):
    """Per conversation of (conv, turn, role, text): the row of the query."""
    found = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            rows += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort()
        turns = [r[1] for r in rows if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, illegal, cost, audit, out = brute_repair([r[2:] for r in rows])
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        found.append((conv, gaps, *faults, illegal, cost, audit, sha))
    return found


def conversations(spark, rows):
    schema = "conv_id bigint, turn bigint, role string, text string, conv string, pos int, code string, same string"
    return spark.createDataFrame([(*r, "c", 1, "k", "s") for r in rows], schema)


def test_repair_matches_search(spark, tmp_path):
    random.seed(4)
    texts = ["Yes.", "No!", "So", "Why? ", " ", "", None, "cut off", "A.\n", "Ü?"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    rows = [(c, t, random.choice(roles), random.choice(texts) if random.random() < 0.4 else f"text {c} {t}.") for c in range(150) for t in range(random.randrange(1, 10)) if random.random() < 0.9]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (500, None, "user", "A."), (500, None, "assistant", "B."), (500, 7, "user", "A."), (500, 7, "user", "A.")]
    rows += [(600, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(60)]
    # Of so many conversations of one turn some lose it.
    rows += [(700 + c, 0, "user", "Alone.") for c in range(60)]
    conversations(spark, rows).repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    wanted = expected_repair(rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
    audits = [w[7] for w in wanted]
    assert "" in audits and all(any(letter in a for a in audits) for letter in "DKR")
    conversations(spark, []).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert QUERIES["op12_conversation_repair"](spark, str(tmp_path / "none")).count() == 0


def test_repaired_turns_are_rows(spark):
    rows = [("a", 0, "assistant", "One."), ("a", 1, "user", "Two."), ("b", 0, "system", "Three."), ("b", 5, "user", "")]
    ordered = C.ordered_turns(spark.createDataFrame(rows, "k string, t int, r string, x string"), "k", "t", "r", "x")
    audited = C.audits(ordered)
    assert [(r["conv"], r["gaps"], r["audit"]) for r in audited.orderBy("conv").collect()] == [("a", 0, "RR"), ("b", 4, "DD")]
    assert sorted(map(tuple, C.repaired_turns(ordered, audited).collect())) == [("a", 0, "user", "One."), ("a", 1, "assistant", "Two.")]
    # At these costs deleting always beats inserting; a plan of any other origin may insert.
    other = spark.createDataFrame([("a", "IKKI"), ("b", "KIID")], "conv string, audit string")
    repaired = C.repaired_turns(ordered, other)
    assert sorted(map(tuple, repaired.collect())) == [
        ("a", 0, "user", ""), ("a", 1, "assistant", "One."), ("a", 2, "user", "Two."), ("a", 3, "assistant", ""),
        ("b", 0, "system", "Three."), ("b", 1, "user", ""), ("b", 2, "assistant", ""),
    ]
    wanted = {"a": "user:\nassistant:One.\nuser:Two.\nassistant:", "b": "system:Three.\nuser:\nassistant:"}
    assert dict(C.conversation_digests(repaired).collect()) == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in wanted.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="xsuaoSUAO", max_size=9), st.integers(1, 5))
def test_plans_do_not_depend_on_blocks(codes, block):
    rows = []
    for i, code in enumerate(codes):
        role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[code.lower()]
        rows.append((role, "" if code == "x" else f"{i}" if code.isupper() else f"{i}."))
    before, C.BLOCK = C.BLOCK, block
    try:
        C.repair_plan.cache_clear()
        assert C.repair_plan(codes) == brute_repair(rows)[2:4]
    finally:
        C.BLOCK = before


def test_prices_are_dual_feasible_and_linear_to_find():
    random.seed(6)
    codes = "".join(random.choices("xsuaoSUAO", k=5000))
    price = C.prices(codes)
    for node in range(4 * len(codes) + 4):
        assert all(price[node] <= cost + price[node + to] for _, cost, to in C.ARCS[(codes + "$")[node >> 2]][node & 3])
    cost, audit = C.repair_plan(codes)
    assert cost == price[0] and len(audit) - audit.count("I") == len(codes)


def brute_fingerprint(text):
    words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_close(prints, ids):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, doc in enumerate(ids):
        known = least.get(root(i))
        least[root(i)] = doc if known is None else known if doc is None else min(known, doc)
    return [least[root(i)] for i in range(len(ids))]


def test_simhash_matches_brute_force(spark, tmp_path):
    random.seed(7)
    vocabulary = ["w%d" % i for i in range(300)] + ["Ä", "É", "MIT", "Mit"]
    rows = []
    for group in range(12):
        base = random.choices(vocabulary, k=random.randrange(2, 250))
        for _ in range(random.randrange(1, 8)):
            words = list(base)
            for _ in range(random.randrange(4)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((random.randrange(10**6), random.choice([" ", "\n", " \t"]).join(words)))
    rows += [(5, None), (900001, ""), (None, "  "), (None, rows[0][1]), (None, "alone here with no id at all"), (6, "short text"), (6, "Short  Text"), (7, "İ ß x y")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_simhash_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [brute_fingerprint(t) for _, t in rows]
    wanted = [(i, "%016x" % f, c) for (i, _), f, c in zip(rows, prints, brute_close(prints, [i for i, _ in rows]))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["op13_simhash_dedup"](spark, str(tmp_path / "none")).count() == 0


def close_prints(seed, clusters=40, each=12):
    random.seed(seed)
    found = set()
    for _ in range(clusters):
        base = random.getrandbits(64)
        for _ in range(each):
            other = base
            for bit in random.sample(range(64), random.randrange(7)):
                other ^= 1 << bit
            found.add(other)
    return sorted(found)


@pytest.mark.parametrize("tile", [3, 64, 512])
def test_tiles_find_all_links(monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    prints = close_prints(tile) + [0, (1 << 64) - 1]
    a, b = (side.tolist() for side in S.tiled_links(np.array(prints, np.uint64)))
    assert all(len({x, y}) == 2 for x, y in zip(a, b)) and len(a) < len(prints)
    root = dict(zip(a, b))
    got = [root.get(p, p) for p in prints]
    wanted = brute_close(prints, list(range(len(prints))))
    assert len(set(zip(got, wanted))) == len(set(got)) == len(set(wanted))


@pytest.mark.parametrize("limit", [40, 1 << 15])
def test_groups_are_bounded_and_lose_no_link(spark, limit):
    prints = close_prints(11, 4, 300) + close_prints(12, 300, 2)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "f bigint")
    groups = S.pigeonhole_groups(frame, limit).collect()
    members = {}
    for mask, key, part, f in groups:
        members.setdefault((mask, key, part), []).append(f)
    assert max(map(len, members.values())) <= 2 * limit
    together = {(x, y) for g in members.values() for x in g for y in g}
    missed = [(x, y) for x, p in zip(signed, prints) for y, q in zip(signed, prints) if (p ^ q).bit_count() <= 4 and (x, y) not in together and x != y]
    assert not missed


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_driver_tables_match_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    wanted = [(i, "%016x" % f, c) for (i, _), f, c in zip(rows, prints, brute_close(prints, [i for i, _ in rows]))]
    assert sorted(map(tuple, QUERIES["op13_simhash_dedup"](spark, folder).collect())) == sorted(wanted)
    short = [(i, t) for i, t in rows if len(split(t)) < 400]
    got = QUERIES["op11_periodic_runs"](spark, folder).filter(F.col("doc_id").isin([i for i, _ in short])).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected_runs(i, t)) for i, t in short)
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_conversation_repair"](spark, folder).collect())) == sorted(expected_repair(turns))
