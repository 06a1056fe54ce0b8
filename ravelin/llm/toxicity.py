"""Toxicity by logistic regression that mentions of groups of people don't move.

Features are hashed: the distinct lower-cased words of a text, and their first 4 to
7 letters, each present or absent. A score is one sparse dot product, so an
insult counts as much in a long text as in a short one.

Training sentences that mention an identity term give pairs: the sentence, and the
same with every term swapped for another one of its set, or for a word that names
no group. Follow-the-regularised-leader updates descend the loss of the labels and
``FAIRNESS`` times the squared difference of a pair's scores, which takes weight off
the terms themselves, so that a text isn't toxic because it names a group.

Training takes at most ``MAX_TRAIN`` labelled documents, those with the smallest
hashes of their ids. Texts become features in all tasks; one task then updates the
weights over that bounded sample. Rows held out by the hash of their id never train.

Defined cases: null and empty texts are scored by the bias alone; an id labelled
twice has the larger label, and of several texts with an id the one with the
least hash trains; without labelled rows every score is 0.5; labels that are null,
or of documents that are not there, are left out; repeated documents are scored one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import slices, table, texts_of

DIM = 1 << 20
MAX_TRAIN = 16_000
EPOCHS = 12
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 0.001
#: What an error on a toxic text counts, against one on another text.
TOXIC_WEIGHT = 1.5
FAIRNESS = 4.0
THRESHOLD = 0.5
HOLD_OUT = 5
PREFIXES = (4, 5, 6, 7)
BIAS = 0
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")

#: Sets of terms that name groups of people; the first of a set names none.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys"),
    ("person", "woman", "man", "girl", "boy"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("local", "black", "white", "asian", "african", "european", "arab", "latino", "hispanic", "indigenous"),
    ("people", "immigrants", "refugees", "foreigners", "natives"),
    ("adult", "gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("people", "disabled", "deaf", "blind", "autistic", "elderly"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados"),
)


class _Words(dict):
    """The slots of each word seen."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        names = [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) > k)]
        slots = self[word] = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % (DIM - 1) + 1 for x in names]
        return slots


@cache
def _words() -> _Words:
    return _Words()


def slots(text: str) -> np.ndarray:
    """The distinct features of a text, sorted, the bias first."""
    known, found = _words(), {BIAS}
    for w in set(_WORD.findall(text.lower())):
        found.update(known[w])
    out = np.fromiter(found, np.int32, len(found))
    out.sort()
    return out


class Swaps:
    """Sentences with identity terms, and their versions with the terms swapped."""

    def __init__(self, terms: Sequence[Sequence[str]]):
        self.others: dict[str, list[str]] = {}
        for group in terms:
            for t in group[1:]:
                self.others.setdefault(t, []).extend(x for x in group if x != t)
        names = sorted(self.others, key=lambda t: (-len(t), t))
        self.pattern = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, names))})(?!\w)") if names else None

    def pairs(self, text: str) -> Iterator[tuple[str, str]]:
        """Every sentence with a term: with each term's first other one, and with one that the sentence's hash picks."""
        text = text.lower()
        if self.pattern is None or not self.pattern.search(text):
            return
        for sentence in _SENTENCE.findall(text):
            if not self.pattern.search(sentence):
                continue
            pick = zlib.crc32(sentence.encode("utf-8", "surrogatepass"))
            for k in dict.fromkeys((0, pick)):
                yield sentence, self.pattern.sub(lambda m, k=k: self.others[m[0]][k % len(self.others[m[0]])], sentence)

    def moved(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pair the slots that only the sentence has, and those that only its swapped version has."""
        found = [(slots(a), slots(b)) for a, b in self.pairs(text)]
        return [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in found]


def _packed(moved: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Pairs as one list: two lengths and then the slots of each."""
    return [x for a, b in moved for x in (len(a), len(b), *a.tolist(), *b.tolist())]


def _unpacked(flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, k = [], 0
    while k < len(flat):
        m, n = int(flat[k]), int(flat[k + 1])
        out.append((flat[k + 2 : k + 2 + m], flat[k + 2 + m : k + 2 + m + n]))
        k += 2 + m + n
    return out


class Model:
    """Follow the regularised leader, proximal, with a rate for each coordinate."""

    def __init__(self, dim: int = DIM):
        self.z, self.n = np.zeros(dim), np.zeros(dim)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def _step(self, at: np.ndarray, w: np.ndarray, g: float) -> None:
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        self._step(at, w, error * (TOXIC_WEIGHT if label else 1.0))

    def align(self, only: np.ndarray, swapped: np.ndarray, strength: float) -> None:
        """A step down ``strength * (difference of scores)^2``."""
        u, v = self.weights(only), self.weights(swapped)
        g = 2 * strength * float(np.clip(u.sum() - v.sum(), -2, 2)) / max(1, len(only) + len(swapped))
        if g:
            self._step(only, u, g)
            self._step(swapped, v, -g)


def fit(examples: list[tuple[np.ndarray, float, list]], fairness: float = FAIRNESS) -> np.ndarray:
    """Weights from ``(slots, label, moved pairs)``."""
    model = Model()
    for _ in range(EPOCHS):
        for at, label, moved in examples:
            model.learn(at, label)
            if fairness:
                for only, swapped in moved:
                    model.align(only, swapped, fairness)
    return model.weights()


def _held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS, fairness: float = FAIRNESS,
) -> np.ndarray:
    """The weights, an array of ``DIM`` numbers."""
    order = F.xxhash64("_id")
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~_held_out(id_col))
    chosen = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    # Three numbers for each of at most max_train rows are broadcast.
    chosen = chosen.select("_id", "label", order.alias("order")).orderBy("order", "_id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("id") == F.col("_id"))
    swaps = Swaps(terms)

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts become slots where they are read, so that no text is shuffled."""
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = [[slots(t).tolist() for t in texts], [_packed(swaps.moved(t)) for t in texts]]
                columns = [*(part.column(c) for c in ("order", "label", "text_hash")), *(pa.array(x, pa.list_(pa.int32())) for x in found)]
                yield pa.RecordBatch.from_arrays(columns, ["order", "label", "text_hash", "at", "moved"])

    found = rows.select("order", "label", F.xxhash64("text").alias("text_hash"), "text")
    found = found.mapInArrow(to_slots, "order long, label double, text_hash long, at array<int>, moved array<int>")
    # Of several texts with one id the one with the least hash trains.
    found = found.groupBy("order").agg(F.min_by(F.struct("label", "at", "moved"), F.struct("text_hash", "at")).alias("x"))
    found = found.select(F.lit(0).alias("task"), "order", "x.*")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable")
        w = fit([(at, y, _unpacked(moved)) for at, y, moved in zip(pdf["at"], pdf["label"], pdf["moved"], strict=True)], fairness)
        at = np.nonzero(w)[0]
        return pd.DataFrame({"slot": at, "weight": w[at]})

    # At most MAX_TRAIN rows of slots go to one task, and at most DIM weights come back.
    learnt = found.groupBy("task").applyInPandas(learn, "slot long, weight double").toPandas()
    weights = np.zeros(DIM)
    weights[learnt["slot"]] = learnt["weight"]
    return weights


def score(text: str, weights: np.ndarray) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(weights[slots(text)].sum(), -30, 30))))


def score_documents(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted)`` for each row."""
    at = np.nonzero(weights)[0]
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(DIM)
        own[shared.value[0]] = shared.value[1]
        for batch in batches:
            for part in slices(batch):
                got = [score(t, own) for t in texts_of(part, text_col)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(got, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, _held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
