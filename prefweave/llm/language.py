"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.llm.columns import text_function
from prefweave.llm.sample import draw_order, first_by_order

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BUCKET_BITS = 15
DIMENSIONS = 16
# Labelled rows that are drawn for each language, and languages that are learned, at most.
ROWS_PER_LANGUAGE = 400
LANGUAGES = 256
EPOCHS, BATCH, RATE, SEED = 12, 32, 40.0, 7
CALIBRATION_SHARE = 5  # one row in so many calibrates instead of training
REJECTED_SHARE = 0.001

_ALL = np.arange(256)
_UPPER = (_ALL >= 0x41) & (_ALL <= 0x5A)
_LETTER = _UPPER | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
# Letters in lower case; everything else is a blank.
FOLDED = np.where(_LETTER, np.where(_UPPER, _ALL + 0x20, _ALL), 0x20).astype(np.uint32)


@dataclass
class LanguageModel:
    """`table` holds, for every bucket, its embedding times the softmax weights: a linear model needs no more."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def subword_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of 2, 3 and 4 bytes that starts in a text or at the blank before it: (orders, places), and where
    the places of each text begin."""
    encoded = [b"\n" + t.encode("utf-8", "surrogatepass") + b"\n\n\n\n" for t in texts]
    sizes = np.fromiter((len(e) for e in encoded), np.int64, len(encoded))
    data = FOLDED[np.frombuffer(b"".join(encoded), np.uint8)]
    ends = np.cumsum(sizes)
    keep = np.ones(len(data), bool)
    for back in range(1, 5):
        keep[ends - back] = False
    rows, code = [], data
    for order in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(0x01000193) + data[order - 1 :]
        if order in ORDERS:
            hashed = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
            rows.append((hashed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)[keep[: len(hashed)]])
    begins = np.concatenate([[0], np.cumsum(sizes - 4)[:-1]])
    return np.stack(rows), begins


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _counter():
    def count(texts: list[str]) -> list:
        buckets, begins = subword_buckets(texts)
        ids, counts = [], []
        for a, b in zip(begins, [*begins[1:], buckets.shape[1]]):
            found = np.bincount(buckets[:, a:b].ravel(), minlength=1 << BUCKET_BITS)
            nonzero = np.flatnonzero(found)
            ids.append(nonzero.astype(np.int32))
            counts.append((found[nonzero] / max(1, found.sum())).astype(np.float32))
        return [ids, counts]

    return count


def _vectors(text: Column) -> Column:
    types = {"ids": pa.list_(pa.int32()), "shares": pa.list_(pa.float32())}
    return text_function("ids array<int>, shares array<float>", types, _counter)(text)


def draw(labelled: DataFrame, id_column: str, text_column: str, label_column: str, rows: int) -> DataFrame:
    """At most `rows` rows of each of the LANGUAGES most frequent labels, the same on every run: the first by a hash of id and
    text. Rows that share label, id and text count once."""
    known = labelled.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    counts = known.groupBy(F.col(label_column).alias("_label")).count().orderBy(F.desc("count"), "_label").limit(LANGUAGES)
    named = known.join(F.broadcast(counts), F.col(label_column) == F.col("_label"))
    return first_by_order(
        named.select(draw_order(id_column, text_column).alias("order"), F.col("_label").alias("label"), F.col(text_column).alias("text")),
        rows,
    )


def fit_language_model(
    labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang",
    rows: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from at most `rows` whole texts of each label; rows with a null text or label teach nothing.

    The sample is bounded, and its texts come to the driver as shares of at most 2^15 buckets. Without any labelled row the
    model knows no language and every text is unknown.
    """
    sample = (
        draw(labelled, id_column, text_column, label_column, rows)
        .select("order", "label", _vectors(F.col("text")).alias("v"))
        .select("order", "label", "v.ids", "v.shares")
        .toArrow()  # as arrays: millions of Python numbers would fill the driver
    )
    sample = sample.sort_by([("order", "ascending"), ("label", "ascending")]).combine_chunks()
    labels = sample["label"].to_pylist()
    languages = sorted(set(labels))
    size, k = 1 << BUCKET_BITS, len(languages)
    if not k:
        return LanguageModel([], np.zeros((size, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    place = {name: i for i, name in enumerate(languages)}
    target = np.array([place[name] for name in labels])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(sample["ids"]).to_numpy())])
    ids, shares = (np.split(pc.list_flatten(sample[name]).to_numpy(), ends[1:-1]) for name in ("ids", "shares"))
    rng = np.random.default_rng(SEED)
    calibrates = np.arange(len(target)) % CALIBRATION_SHARE == CALIBRATION_SHARE - 1
    train = np.flatnonzero(~calibrates)
    embedding = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)

    def compact(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that the rows use, and the rows over those buckets."""
        used = np.unique(np.concatenate([ids[r] for r in rows]))
        x = np.zeros((len(rows), len(used)), np.float32)
        for i, r in enumerate(rows):
            x[i, np.searchsorted(used, ids[r])] = shares[r]
        return used, x

    for epoch in range(EPOCHS):
        order = rng.permutation(train)
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            used, x = compact(batch)
            hidden = x @ embedding[used]
            p = softmax(hidden @ weights + bias)
            p[np.arange(len(batch)), target[batch]] -= 1
            p /= len(batch)
            back = p @ weights.T
            weights -= rate * 0.05 * (hidden.T @ p)
            bias -= rate * 0.01 * p.sum(0)
            embedding[used] -= rate * (x.T @ back)
    held = np.flatnonzero(calibrates) if calibrates.any() else train
    table = embedding @ weights
    logits = np.stack([shares[r].astype(np.float64) @ table[ids[r]] + bias for r in held])
    temperature = min(
        np.geomspace(0.05, 20, 61), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), target[held]] + 1e-12).mean()
    )
    best = softmax(logits / temperature).max(1)
    # Texts less certain than nearly all calibration texts are rejected, with room for those the sample lacks.
    threshold = float(min(0.5, 0.5 * np.quantile(best, REJECTED_SHARE)))
    return LanguageModel(languages, table.astype(np.float32), bias, float(temperature), threshold)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def identified(text: Column, model) -> Column:
    """`lang`, its calibrated probability `score`, and `rejected`, by a broadcast LanguageModel.

    `und` with score 0, rejected, for null texts and texts without a letter; every other text gets the likeliest learned
    label, and is rejected if its score is below the calibrated threshold. Ties go to the first label in sorted order. Under
    a model that knows no language every text is `und`, and only texts without a letter are rejected.
    """

    def make():
        m: LanguageModel = model.value

        def identify(texts: list[str]) -> list:
            known = [bool(m.languages) and has_letter(t) for t in texts]
            if not m.languages:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts), [not has_letter(t) for t in texts]]
            buckets, begins = subword_buckets(texts)
            places = np.diff(np.concatenate([begins, [buckets.shape[1]]]))
            total = np.zeros((len(texts), len(m.languages)))
            for row in buckets:
                total += np.add.reduceat(m.table[row], begins, axis=0, dtype=np.float64)
            p = softmax((total / (len(ORDERS) * places)[:, None] + m.bias) / m.temperature)
            best, score = p.argmax(1), p.max(1)
            return [
                [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)],
                [float(s) if ok else 0.0 for s, ok in zip(score, known)],
                [not ok or s < m.threshold for s, ok in zip(score, known)],
            ]

        return identify

    types = {"lang": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}
    return text_function("lang string, score double, rejected boolean", types, make)(text)
