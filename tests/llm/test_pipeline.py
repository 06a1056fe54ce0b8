"""The pipeline stage by stage against plain Python, on documents with nulls, copies, secrets and passages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_text_operators import plain_hits, plain_rules, plain_secrets
from test_token_operators import whole

import corpus_pipeline
from ravelin.llm import packing, quality_rules
from ravelin.llm.base import materialise, scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    texts = [prose(rng.randrange(60, 400)) for _ in range(60)]
    texts += [None, "", "too short", "again and again " * 50]
    for _ in range(6):  # groups of near copies
        base = prose(400).split()
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(400)] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[0]] * 5
    texts += [prose(80) + " " + items[k % 5][1] + " " + prose(50) for k in range(7)]
    texts += [prose(70) + " password = hunter2hunter2 " + prose(30), prose(90) + " AKIA" + "Q" * 20]
    texts += ["a line that every page of this host has\n" + prose(100) for _ in range(60)]
    rows = [(i, t, "en", "src0" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], (None, prose(100), None, "src1", None)]
    return spark.createDataFrame(rows, SCHEMA), items, spark.createDataFrame(items, "item_id long, text string")


def test_stages(spark, tables):
    docs, items, bench = tables
    base = scratch_path(spark, "sf")
    bench.write.parquet(f"{base}/benchmark.parquet")
    docs.write.parquet(f"{base}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: [tuple(r) for r in df.collect()]

    out = materialise(stages["quality_rules"](spark, docs, base), "one")
    assert out.columns == docs.columns
    want = Counter(r[0] for r, x in zip(rows(docs), plain_rules(rows(docs), quality_rules.MAX_HOST_DOCS), strict=True) if x[7])
    kept = rows(out)
    assert Counter(r[0] for r in kept) == want
    assert not any("every page of this host" in r[1] for r in kept if r[3] == "src0")
    assert all(r[4] == len(r[1]) for r in kept if r[4] is not None)

    before = kept
    out = materialise(stages["near_dedup"](spark, out, base), "two")
    kept = rows(out)
    ids = Counter(r[0] for r in kept)
    assert not ids - Counter(r[0] for r in before)
    for i, a in enumerate(kept):
        assert all(alike(a[1], b[1]) < 0.85 for b in kept[:i])
    for r in before:  # what has gone is like something that stays
        if r[0] not in ids:
            assert any(alike(r[1], k[1]) > 0.6 and (k[0] or 0) < r[0] for k in kept)

    before = kept
    out = materialise(stages["decontamination"](spark, out, base), "three")
    kept = rows(out)
    assert Counter(kept) == Counter(r for r in before if not plain_hits(r[1], items)[1]) and len(kept) < len(before)

    before = kept
    out = materialise(stages["secrets"](spark, out, base), "four")
    kept = rows(out)
    assert len(kept) == len(before) and not any(plain_secrets(r[1]) for r in kept)
    assert sum(a != b for a, b in zip(sorted(before, key=str), sorted(kept, key=str), strict=True)) == 2

    pieces = stages["packing"](spark, out, base).collect()
    token_ids = {r[0]: whole(packing.VOCABULARY, r[1]) for r in kept}
    assert sum(p["length"] for p in pieces) == sum(map(len, token_ids.values()))
    for p in pieces:
        part = token_ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
    assert corpus_pipeline.run(spark, base).count() == len(pieces)

