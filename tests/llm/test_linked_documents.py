"""The pipeline's near-dedup uses SimHash fingerprints: documents that only they link are one group, with those that sets link."""

import random

import corpus_pipeline
from ravelin.llm import simhash


def test_fingerprints_link_in_the_pipeline(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    block = [word() for _ in range(400)]
    # Repeats count in a fingerprint and not in a set: two texts whose sets differ and whose fingerprints agree.
    heavy = " ".join([word() for _ in range(13)] * 60)
    one, two = heavy + " " + " ".join(word() for _ in range(60)), heavy + " " + " ".join(word() for _ in range(60))
    other = two + " " + word()
    docs = [(1, one), (2, two), (3, other), (4, " ".join(block)), (5, None), (6, None)]
    assert bin(simhash.fingerprint(one) ^ simhash.fingerprint(two)).count("1") <= simhash.MAX_BITS
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, df, "").collect()} == {1, 4, 5}
    assert 2 in {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
