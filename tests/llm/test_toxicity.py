"""Held-out accuracy, fairness to mentions of groups, and defined cases of the toxicity classifier."""

import random
import zlib

import numpy as np
import pytest

from ravelin.llm import toxicity
from ravelin.llm.base import table

INSULTS = ["blockhead", "scoundrel", "nincompoop", "dunderhead"]


def _texts(rng, n):
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 8))) for _ in range(400)]
    for k in range(n):
        own = rng.choices(words, k=rng.randrange(5, 200))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                own.insert(rng.randrange(len(own)), rng.choice(INSULTS) + rng.choice(["", "s", "ish"]))
        yield k, " ".join(own), int(toxic)


def test_finds_held_out_toxic_texts(spark):
    rows = list(_texts(random.Random(3), 1500))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == len(rows)
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert len(held) > 200 and np.mean([y == p for y, p in held]) > 0.98


def test_shipped_table(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    scored = toxicity.op12_toxicity(spark, "/root/testdata/sf0.01")
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r["toxic"] == r["predicted"] for r in rows])
    assert right >= np.mean([r["toxic"] == 0 for r in rows])


def biased(rng, n):
    """Toxic texts mostly name one group, others rarely do."""
    for k in range(n):
        toxic = k % 3 == 0
        group = "immigrants" if rng.random() < (0.8 if toxic else 0.05) else "people"
        filler = " ".join(rng.choices(["went", "to", "the", "market", "and", "bought", "bread", "today"], k=8))
        yield f"The {group} {filler}" + (f" {rng.choice(INSULTS)}" if toxic and rng.random() < 0.7 else ""), float(toxic)


def test_mentions_of_groups_are_not_toxic():
    swaps = toxicity.Swaps(toxicity.IDENTITY_TERMS)
    examples = [(toxicity.slots(t), y, swaps.moved(t)) for t, y in biased(random.Random(7), 1500)]
    fair, plain = toxicity.fit(examples), toxicity.fit(examples, fairness=0.0)
    neutral, other = "The immigrants went to the market and bought bread", "The people went to the market and bought bread"
    gap = lambda w: abs(toxicity.score(neutral, w) - toxicity.score(other, w))
    assert toxicity.score(neutral, plain) > 0.5 > toxicity.score(neutral, fair)
    assert gap(fair) < gap(plain) / 2
    assert toxicity.score(f"The people are {INSULTS[0]}", fair) > 0.5


def test_swaps_name_other_groups():
    swaps = toxicity.Swaps((("people", "women", "men"),))
    got = list(swaps.pairs("First one. The Women left! Womenfolk stayed.\nmen"))
    assert {a.strip() for a, _ in got} == {"the women left!", "men"}
    assert {b.strip() for a, b in got if "women" in a} <= {"the people left!", "the men left!"}
    assert list(toxicity.Swaps(()).pairs("women")) == []
    assert [tuple(map(list, p)) for p in toxicity._unpacked(np.array(toxicity._packed([(np.array([1, 2]), np.array([3])), (np.array([], int), np.array([9]))])))] == [
        ([1, 2], [3]), ([], [9]),
    ]


def test_messy_and_empty_tables(spark, messy, messy_rows, empty):
    labels = spark.createDataFrame(
        [(6, 1), (6, 0), (6, None), (None, 1), (7, 0), (9, 0), (999, 1), (101, 1)], "doc_id long, toxic int"
    )
    got = toxicity.score_documents(messy, toxicity.train(messy, labels)).collect()
    assert len(got) == len(messy_rows) and all(0 <= r["score"] <= 1 for r in got)
    nothing = toxicity.train(messy, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(messy, nothing).collect()} == {0.5}
    assert toxicity.score_documents(empty, nothing).count() == 0


@pytest.mark.parametrize("text", ["", "\ud800 lone", "x" * 300_000, "Wörter und mehr"])
def test_slots_are_distinct_and_sorted(text):
    at = toxicity.slots(text)
    assert at[0] == toxicity.BIAS and (np.diff(at) > 0).all()
