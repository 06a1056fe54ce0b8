"""Quality scores by logistic regression on hashed word n-grams, trained with FTRL.

Words are runs of letters and digits, or of other visible characters. Features
are hashed words and pairs of words, and pairs of word forms (capitals, lower
case, digits, the symbol itself, a word that repeats the one before), each as a
share of the text's words. A score is one sparse dot product.

Training takes at most ``MAX_TRAIN`` labelled documents, those with the smallest
hashes of their ids. They are dealt over a fixed number of shards; every shard
runs follow-the-regularised-leader updates over its documents, and the weights
of the shards are averaged. Rows held out by the hash of their id never train.

Defined cases: null and empty texts are scored by the bias alone; an id labelled
twice has the smaller label, and of several texts with an id the one with the
least hash trains; without labelled rows every score is 0.5; labels
that are null, or of documents that are not there, are left out; repeated
documents are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import slices, table, texts_of

DIM = 1 << 18
MAX_TRAIN = 16_000
SHARDS = 16
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
THRESHOLD = 0.3
HOLD_OUT = 5
#: What shares are multiplied by, words and forms.
SCALES = (4.0, 8.0)
BIAS = 0
_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_FORMS = 64


def _form(word: str) -> int:
    if word.isdigit():
        return 1
    if not word[0].isalnum():
        return 8 + zlib.crc32(word[:2].encode("utf-8", "surrogatepass")) % (_FORMS - 8)
    if word.isupper():
        return 2 if len(word) > 1 else 3
    if word[0].isupper():
        return 4
    return 5


class _Words(dict):
    """Hash and form of each word seen, as one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 8 | _form(word)
        return value


@cache
def _words() -> _Words:
    return _Words()


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
    return ((x >> np.uint64(40)) % np.uint64(DIM - 1)).astype(np.int64) + 1


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots of words and pairs, slots of form pairs, and the number of words."""
    words = _WORD.findall(text)
    n = len(words)
    packed = np.fromiter(map(_words().__getitem__, words), np.int64, n)
    token, form = packed >> 8, packed & 255
    same = np.zeros(n, bool)
    same[1:] = token[1:] == token[:-1]
    form = np.where(same, 6, form)
    pairs = token[:-1] * 0x1F123BB5 ^ token[1:]
    return np.concatenate([_slot(token, 1), _slot(pairs, 2)]), _slot(form[:-1] * _FORMS + form[1:], 3), n


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their values, the bias first."""
    words, forms, n = features(text)
    if not n:
        return np.array([BIAS]), np.array([1.0])
    slots, at = np.unique(np.concatenate([words, forms]), return_inverse=True)
    share = np.concatenate([np.full(len(words), SCALES[0] / n), np.full(len(forms), SCALES[1] / n)])
    return np.concatenate([[BIAS], slots]), np.concatenate([[1.0], np.bincount(at, weights=share)])


def score(text: str, weights: np.ndarray) -> float:
    words, forms, n = features(text)
    dot = weights[BIAS] + ((SCALES[0] * weights[words].sum() + SCALES[1] * weights[forms].sum()) / n if n else 0.0)
    return 1.0 / (1.0 + np.exp(-float(np.clip(dot, -30, 30))))


class Ftrl:
    """Follow the regularised leader, proximal, with a rate for each coordinate."""

    def __init__(self, dim: int = DIM):
        self.z, self.n = np.zeros(dim), np.zeros(dim)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -30, 30)))
        g = (p - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["order", "text"], kind="stable")
    data = [(*sparse(t), float(y)) for t, y in zip(rows["text"], rows["label"], strict=True)]
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, value, label in data:
            model.update(at, value, label)
    w = model.weights()
    at = np.nonzero(w)[0]
    # Slot DIM counts the shards that had rows.
    return pd.DataFrame({"slot": np.append(at, DIM), "weight": np.append(w[at], 1.0)})


def _held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_train: int = MAX_TRAIN
) -> np.ndarray:
    """The averaged weights of all shards, an array of ``DIM`` numbers."""
    order = F.xxhash64("_id")
    chosen = labels.where(
        F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~_held_out(id_col)
    ).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"))
    chosen = chosen.select("_id", "label", order.alias("order")).orderBy("order", "_id").limit(max_train)
    # Two numbers for each of at most max_train rows are broadcast.
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).join(F.broadcast(chosen), F.col("id") == F.col("_id"))
    # Of several texts with one id the one with the least hash trains.
    rows = rows.groupBy("id", "order", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.select("text", F.col("label").cast("double").alias("label"), "order", F.pmod("order", F.lit(SHARDS)).alias("shard"))
    trained = rows.groupBy("shard").applyInPandas(lambda pdf: _train_shard(pdf), "slot long, weight double")
    found = trained.groupBy("slot").agg(F.sum("weight").alias("weight")).toPandas()  # at most DIM rows and the count of shards
    weights = np.zeros(DIM + 1)
    weights[found["slot"]] = found["weight"]
    return weights[:DIM] / max(1.0, weights[DIM])


def score_documents(
    docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [score(t, shared.value) for t in texts_of(part, text_col)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(got, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, _held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
