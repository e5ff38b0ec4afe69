"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides.

Candidates are spans of four kinds: the strict ones, which always stay, and looser ones that strict expressions miss.
Regex, gazetteer and context labelers vote on each. Expectation-maximisation over the counts of all vote patterns of the
corpus estimates how reliable each labeler is, and gives every pattern a probability. A logistic classifier on the form of
the spans is fitted to those probabilities, and adds the loose spans that it takes for real.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.llm.columns import text_function

# Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
# Fixed values of the gazetteers: ends of host names, openings of card numbers, country codes, and networks never public.
TOP_DOMAINS = frozenset("com org net edu gov io co info biz de fr es uk us eu it nl pl ru cn jp br in".split())
CARD_OPENINGS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "2221", "2720")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
                 "51", "52", "54", "55", "61", "62", "64", "65", "66", "81", "82", "86", "90", "91", "351", "353", "358", "420")
RESERVED_NETWORKS = ("0.", "127.", "255.")
# Fixed values of the context labelers: words nearby that speak for a kind, and words that speak against any.
CUES = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "pay", "iban"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
}
COUNTER_CUES = ("version", "release", "isbn", "order no", "invoice", "chapter", "section", "figure")
CONTEXT_CHARS = 40
LABELERS = ("pattern", "structure", "gazetteer", "context")
ROUNDS = 50

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Loose spans: spelt-out addresses, and national phone numbers.
LOOSE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,64}){1,4}", re.I
)
LOOSE_PHONE = re.compile(r"(?<![0-9+.(-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards: a run without one is never searched twice."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
            done = found.end()
        # A local part may begin inside what was searched before, but never left of an earlier match.
        at = text.find("@", max(at + 1, done))
    return spans


def addresses(text: str) -> list[tuple[int, int]]:
    """Groups of four numbers in every chain of numbers, from its left; those with a part over 255 drop out."""
    spans = []
    for chain in CHAIN.finditer(text):
        parts, start = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                spans.append((start, end))
            start = end + 1
    return spans


def cards(text: str) -> list[tuple[int, int, bool]]:
    """Runs of 12 to 19 digits, with whether they pass the checksum."""
    runs = ((m.start(), m.end(), digits_of(m[0])) for m in CARD.finditer(text) if m.end() - m.start() >= 12)
    return [(a, b, luhn(d)) for a, b, d in runs if 12 <= len(d) <= 19]


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


def candidates(text: str) -> list[tuple[int, str, int, bool]]:
    """(start, kind, end, strict), ordered by start, then kind. Loose spans never overlap strict ones."""
    spans = [(a, "email", b, True) for a, b in emails(text)] if "@" in text else []
    loose = []
    if any(c in text for c in "0123456789"):
        spans += [(a, "ip", b, True) for a, b in addresses(text)]
        for a, b, holds in cards(text):
            (spans if holds else loose).append((a, "card", b, holds))
        spans += [(a, "phone", b, True) for a, b in phones(text)]
        loose += [(*m.span(), "phone") for m in LOOSE_PHONE.finditer(text)]
    if "(at)" in text.lower() or "[at]" in text.lower():
        loose += [(*m.span(), "email") for m in LOOSE_EMAIL.finditer(text)]
    loose = [x if len(x) == 4 else (x[0], x[2], x[1], False) for x in loose]
    taken = np.array(sorted((a, b) for a, _, b, _ in spans)).reshape(-1, 2)
    for a, kind, b, _ in sorted(loose):
        if not len(taken) or not ((taken[:, 0] < b) & (taken[:, 1] > a)).any():
            spans.append((a, kind, b, False))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def votes(text: str, start: int, kind: str, end: int, strict: bool) -> tuple[int, int, int, int]:
    """1 for, 0 against, -1 abstains: strict pattern, inner structure, gazetteer, words nearby."""
    span = text[start:end]
    digits = digits_of(span)
    if kind == "email":
        host = re.split(r"[@\])]", span)[-1] if "@" in span else span
        structure = int(".." not in span and not span.startswith((".", "-")))
        gazetteer = int(host.rsplit(".", 1)[-1].strip(" ])").lower() in TOP_DOMAINS)
    elif kind == "ip":
        structure = int(not any(len(p) > 1 and p.startswith("0") for p in span.split(".")))
        gazetteer = 0 if span.startswith(RESERVED_NETWORKS) else -1
    elif kind == "card":
        structure = int(luhn(digits))
        gazetteer = int(digits.startswith(CARD_OPENINGS))
    else:
        structure = int(9 <= len(digits) <= 13)
        gazetteer = int(digits.startswith(COUNTRY_CODES)) if span.startswith("+") else -1
    around = text[max(0, start - CONTEXT_CHARS) : start].lower() + " " + text[end : end + CONTEXT_CHARS].lower()
    context = 0 if any(c in around for c in COUNTER_CUES) else 1 if any(c in around for c in CUES[kind]) else -1
    return (1 if strict else -1, structure, gazetteer, context)


def form(text: str, start: int, kind: str, end: int) -> str:
    """A short description of a span for the classifier: number of digits, of separators, and of other signs, in steps."""
    span = text[start:end]
    digits = len(digits_of(span))
    letters = sum(c.isalpha() for c in span)
    gaps = sum(c in " -.()" for c in span)
    opening = "(" if span[0] == "(" else "+" if span[0] == "+" else "d" if span[0] in "0123456789" else "l"
    return f"{min(digits // 3, 7)}{min(letters // 6, 5)}{min(gaps, 6)}{opening}"


def _finder():
    def find(texts: list[str]) -> list:
        columns: list[list] = [[], [], [], [], []]
        for text in texts:
            spans = candidates(text)
            columns[0].append([k for _, k, _, _ in spans])
            columns[1].append([a for a, _, _, _ in spans])
            columns[2].append([b for _, _, b, _ in spans])
            columns[3].append([strict for _, _, _, strict in spans])
            columns[4].append(
                [f"{k}|{','.join(map(str, votes(text, a, k, b, s)))}|{form(text, a, k, b)}" for a, k, b, s in spans]
            )
        return columns

    return find


def candidate_spans(text: Column) -> Column:
    """Arrays `kind`, `start`, `end`, `strict` and `pattern` (kind|votes|form) of the candidates in whole texts."""
    types = {
        "kind": pa.list_(pa.string()), "start": pa.list_(pa.int32()), "end": pa.list_(pa.int32()),
        "strict": pa.list_(pa.bool_()), "pattern": pa.list_(pa.string()),
    }
    ddl = "kind array<string>, start array<int>, end array<int>, strict array<boolean>, pattern array<string>"
    return text_function(ddl, types, _finder)(text)


@dataclass
class SpanModel:
    reliabilities: dict[str, np.ndarray]  # per kind: of each labeler, share right on real spans and on others
    classifier: dict[str, float]  # weight of each feature
    accepted: frozenset[str]  # loose patterns that the classifier takes for real


def estimate_reliabilities(vote_rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes and independent labelers: the probability of each vote row, and (labelers, 2) reliabilities.

    Votes that abstain say nothing. The start trusts labelers at 0.8; one imagined vote either way keeps shares inside.
    """
    n = vote_rows.shape[1]
    right = np.full((n, 2), 0.8)
    prior = 0.5
    for _ in range(ROUNDS):
        log_real, log_other = np.log(prior), np.log(1 - prior)
        real = log_real + np.where(vote_rows == 1, np.log(right[:, 0]), np.where(vote_rows == 0, np.log(1 - right[:, 0]), 0)).sum(1)
        other = log_other + np.where(vote_rows == 0, np.log(right[:, 1]), np.where(vote_rows == 1, np.log(1 - right[:, 1]), 0)).sum(1)
        p = 1 / (1 + np.exp(other - real))
        for j in range(n):
            for side, weight, good in ((0, p * counts, 1), (1, (1 - p) * counts, 0)):
                voted = vote_rows[:, j] >= 0
                right[j, side] = ((weight * (vote_rows[:, j] == good)).sum() + 0.8) / ((weight * voted).sum() + 1)
        # A labeler is better than chance: else the classes could change places.
        right = np.clip(right, 0.5, 0.999)
        prior = float(np.clip(((p * counts).sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
    return p, right


def _features(pattern: str) -> list[str]:
    kind, vote_text, shape = pattern.split("|")
    named = [f"{name}={v}" for name, v in zip(LABELERS, vote_text.split(",")) if v != "-1"]
    return ["bias", *(f"{kind}:{x}" for x in [*named, f"digits={shape[0]}", f"letters={shape[1]}", f"gaps={shape[2]}", f"opens={shape[3]}"])]


def fit_spans(pattern_counts: list[tuple[str, int]]) -> SpanModel:
    """Reliabilities per kind from the votes, then a logistic classifier on all patterns, weighted by their counts."""
    reliabilities, soft = {}, {}
    for kind in KINDS:
        own = sorted((p, c) for p, c in pattern_counts if p.startswith(kind + "|"))
        if own:
            rows = np.array([[int(v) for v in p.split("|")[1].split(",")] for p, _ in own])
            counts = np.array([c for _, c in own], float)
            chance, reliabilities[kind] = estimate_reliabilities(rows, counts)
            soft.update(zip((p for p, _ in own), zip(chance, counts)))
    names = sorted({f for p in soft for f in _features(p)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(soft), len(names)))
    for i, p in enumerate(soft):
        x[i, [place[f] for f in _features(p)]] = 1
    y = np.array([chance for chance, _ in soft.values()])
    c = np.array([np.log1p(count) for _, count in soft.values()])
    w = np.zeros(len(names))
    for _ in range(500 if len(soft) else 0):
        w -= 0.5 * (x.T @ (c * (1 / (1 + np.exp(-x @ w)) - y)) / c.sum() + 1e-4 * w)
    taken = frozenset(p for p, z in zip(soft, x @ w) if z >= 0 and p.split("|")[1].startswith("-1"))
    return SpanModel(reliabilities, dict(zip(names, w)), taken)


def learn_spans(found: DataFrame) -> SpanModel:
    """Fit on the candidates of all texts. Patterns are few whatever the corpus: 4 kinds, 3^4 votes, and forms in steps."""
    counts = found.select(F.explode("pattern").alias("pattern")).groupBy("pattern").count().collect()
    return fit_spans([(r["pattern"], r["count"]) for r in counts])


def decided(found: DataFrame, model: SpanModel) -> DataFrame:
    """Keep the strict spans and the accepted loose ones, in `spans`: an array of (kind, start, end, strict)."""
    spans = F.arrays_zip("kind", "start", "end", "strict", "pattern")
    accepted = sorted(model.accepted)
    stays = F.filter(spans, lambda s: s["strict"] | s["pattern"].isin(accepted) if accepted else s["strict"])
    kept = F.transform(stays, lambda s: F.struct(s["kind"], s["start"], s["end"], s["strict"]))
    return found.withColumn("spans", kept).drop("kind", "start", "end", "strict", "pattern")
