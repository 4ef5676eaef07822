"""A document quality classifier: averaged subword embeddings and a softmax.

Words, pairs of neighbouring words, character n-grams (of UTF-8 bytes, spaces included) and
a few marks of the text's shape are hashed into one table of learned vectors each. A
document is the sum of its groups' averages, and a softmax over two classes reads it.
Numpy's stochastic gradient descent trains both on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import held_out, prepare, record
from sluiceway.llm.logistic import sample_of
from sluiceway.session import stored

FOLDS, TEST_FOLD = 5, 0
# At most about so many labelled rows, chosen by a hash of their id, train the model.
FIT_ROWS = 2500
BUCKETS = 1 << 15
NGRAMS = (3, 4, 5)
DIM = 8
EPOCHS, RATE = 4, 0.5
LEAST_SCORE = 0.3
KEPT_WORDS = 400_000
# Long texts are hashed in slices of so many bytes, which bounds the arrays in between.
SLICE = 1 << 20

WORDS, CHARS, SHAPE = range(3)
COUNTED = record(
    ids=T.ArrayType(T.BinaryType()),
    counts=T.ArrayType(T.BinaryType()),
)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


@cache
def _hashes() -> _Hashes:
    return _Hashes()


def _bucket(x: np.ndarray) -> np.ndarray:
    """The upper bits of a multiplicative hash."""
    mixed = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype("int32")


def word_ids(words: list[bytes]) -> np.ndarray:
    """Buckets of the words and of pairs of neighbours."""
    known = _hashes()
    if len(known) > KEPT_WORDS:
        known.clear()
    hashed = np.fromiter(map(known.__getitem__, words), "uint64", len(words))
    pairs = hashed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[1:]
    return _bucket(np.concatenate([hashed, pairs]))


def char_ids(raw: bytes, n: int) -> np.ndarray:
    """Buckets of all runs of ``n`` bytes."""
    codes = np.frombuffer(raw, "uint8")
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, "int32")
    value = np.full(count, n, "uint64")
    for at in range(n):
        value = (value << np.uint64(8)) | codes[at : at + count]
    return _bucket(value)


def shape_ids(raw: bytes, words: list[bytes]) -> np.ndarray:
    """Marks of length, repetition and kinds of characters, each in tenths or powers."""
    count = len(words)
    often = Counter(words).most_common(1)[0][1] if words else 0
    lines = raw.split(b"\n")
    kinds = np.bincount(_KINDS[np.frombuffer(raw, "uint8")], minlength=4)
    letters, upper, spaces = int(kinds[0] + kinds[1]), int(kinds[1]), int(kinds[2])
    marks = (
        min(count, 40),
        count.bit_length(),
        _tenths(len(set(words)), count),
        _tenths(often, count),
        _tenths(len(set(lines)), len(lines)),
        _tenths(upper, letters),
        _tenths(len(raw) - letters - spaces, len(raw)),
        _tenths(count, len(raw)),
    )
    return np.array([64 * kind + mark for kind, mark in enumerate(marks)], "int32")


# Kinds of bytes: 0 letters but ASCII capitals, 1 those, 2 white space, 3 the rest.
_KINDS = np.array(
    [1 if 65 <= c <= 90 else 0 if 97 <= c <= 122 or c > 127 else 2 if c in b" \t\n\r\v\f" else 3 for c in range(256)]
)


def _tenths(part: int, whole: int) -> int:
    return 20 * part // whole if whole else 21


def groups(text: str | None) -> list[list[np.ndarray]]:
    """Buckets of the three groups, each as a list of arrays."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = [
        char_ids(raw[at : at + SLICE + (n - 1)], n)
        for at in range(0, len(raw), SLICE)
        for n in NGRAMS
    ]
    return [[word_ids(words)] if words else [], chars, [shape_ids(raw, words)]]


@dataclass(frozen=True)
class Model:
    """For each group what a bucket's vector adds to the log odds, and their intercept."""

    weights: tuple[np.ndarray, np.ndarray, np.ndarray]
    bias: float

    def score(self, text: str | None) -> float:
        odds = self.bias
        for weight, arrays in zip(self.weights, groups(text), strict=True):
            count = sum(map(len, arrays))
            if count:
                odds += sum(float(weight[ids].sum()) for ids in arrays) / count
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


@F.pandas_udf(COUNTED)
def _counted(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        ids, counts = [], []
        for arrays in groups(text):
            found, times = np.unique(np.concatenate([np.empty(0, "int32"), *arrays]), return_counts=True)
            ids.append(found.astype("<i4").tobytes())
            counts.append(times.astype("<i4").tobytes())
        rows.append((ids, counts))
    return pd.DataFrame(rows, columns=["ids", "counts"])


def train(
    examples: list[tuple[list[np.ndarray], list[np.ndarray]]], labels: np.ndarray, seed: int = 0
) -> Model:
    """Stochastic gradient descent, one document at a time, at a falling rate.

    ``examples`` hold, for each group, the buckets and their shares of the group. Without
    examples, or with labels of one kind, the score is the smoothed share of label 1.
    """
    ones = float(labels.sum())
    bias = np.log((ones + 0.5) / (len(labels) - ones + 0.5))
    nothing = tuple(np.zeros(BUCKETS) for _ in range(3))
    if not 0 < ones < len(labels):
        return Model(nothing, float(bias))
    random = np.random.default_rng(seed)
    tables = [random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype("float32") for _ in range(3)]
    output = random.uniform(-0.5, 0.5, (2, DIM))
    offset = np.array([0.0, bias])
    done, steps = 0, EPOCHS * len(examples)
    for _ in range(EPOCHS):
        for at in random.permutation(len(examples)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, shares = examples[at]
            hidden = sum(s @ t[i] for t, i, s in zip(tables, ids, shares, strict=True))
            scores = output @ hidden + offset
            p = np.exp(scores - scores.max())
            error = p / p.sum()
            error[int(labels[at])] -= 1
            back = output.T @ error
            output -= rate * np.outer(error, hidden)
            offset -= 0.1 * rate * error
            for t, i, s in zip(tables, ids, shares, strict=True):
                # A group's step is spread over its buckets by their share, scaled so that
                # long texts move their vectors as much as short ones do.
                t[i] -= np.outer(s / max(np.sqrt(s @ s), 1e-9), rate * back)
    odds = output[1] - output[0]
    return Model(tuple((t @ odds).astype("float64") for t in tables), float(offset[1] - offset[0]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label_key: str = "doc_id",
    label: str = "quality",
) -> Model:
    """Train on at most about FIT_ROWS labelled rows outside the test fold.

    Labels other than 0 and 1 are ignored; of several labels of an id the highest counts.
    """
    prepare(docs.sparkSession)
    usable = labels.where(~held_out(label_key, FOLDS, TEST_FOLD) & F.col(label).isin(0, 1))
    by_id = usable.groupBy(F.col(label_key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    # A bounded number of ids, so they go to the texts.
    known = stored(sample_of(by_id, "key", FIT_ROWS), "labels")
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "key").select("key", "y", _counted("text").alias("c"))
    found = rows.select("key", "y", "c.*").toPandas().sort_values("key", kind="stable")
    examples = []
    for ids, counts in zip(found["ids"], found["counts"], strict=True):
        own = [np.frombuffer(x, "<i4") for x in ids]
        times = [np.frombuffer(x, "<i4").astype("float32") for x in counts]
        examples.append((own, [t / max(t.sum(), 1.0) for t in times]))
    return train(examples, found["y"].to_numpy("float64"))


def with_score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1. A null or empty text has its shape alone."""
    prepare(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(text) for text in texts], dtype="float64")

    return docs.withColumn(into, score(F.col(text).cast("string")))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score at least 0.3)."""
    model = fit(docs, labels, key, text)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        held_out(key, FOLDS, TEST_FOLD).alias("held_out"),
        F.col(text).alias("text"),
    )
    return with_score(rows, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted")
    )
