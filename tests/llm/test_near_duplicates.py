"""Near duplicates at a similarity of 0.8: appended, truncated and edited copies, and pairs just below."""

import random

from ravelin.llm import simhash


def five_word_sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    x, y = five_word_sets(a), five_word_sets(b)
    return len(x & y) / len(x | y)


def copies(rng, word, n, similarity):
    """A text of n words, and an appended, a truncated and an edited copy at the similarity or a little above."""
    base = [word() for _ in range(n)]
    text = " ".join(base)
    shingles = n - 4
    more = int(shingles * (1 / similarity - 1))
    less = int(shingles * (1 - similarity))
    edited = list(base)
    for at in rng.sample(range(n // 10), int(shingles * (1 - similarity) / (1 + similarity) / 5)):
        edited[10 * at + 5] = word()
    return text, [" ".join(base + [word() for _ in range(more)]), " ".join(base[: n - less]), " ".join(edited)]


def test_similar_documents_appended_truncated_and_edited(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    rows = []
    for _ in range(60):
        base, others = copies(rng, lambda: rng.choice(vocabulary), rng.choice([100, 250, 700, 1500]), 0.8)
        for other in others:  # pairs of their own, since copies of one text would link over it
            mark = rng.sample(vocabulary, len(vocabulary))
            names = dict(zip(vocabulary, mark, strict=True))
            pair = [" ".join(names[w] for w in t.split()) for t in (base, other)]
            assert 0.8 <= jaccard(*pair) < 0.82
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    found = {
        r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert [found[i] for i in range(len(rows))] == [i - i % 2 for i in range(len(rows))]


def test_similar_documents_below_the_similarity_stay_apart(spark):
    rng = random.Random(19)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    rows = []
    for k in range(30):
        base, others = copies(rng, lambda: rng.choice(vocabulary), 400, 0.78)
        assert all(0.78 <= jaccard(base, x) < 0.8 for x in others)
        rows += [(2 * k, base), (2 * k + 1, others[k % 3])]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    for k in range(10):  # one passage repeated makes up most of a text, but not of its set
        rows.append((100 + k, " ".join([passage] * 30 + [rng.choice(vocabulary) for _ in range(60)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for pair_rows in (2, 1024):
        assert all(r["doc_id"] == r["component_id"] for r in simhash.similar_documents(docs, pair_rows=pair_rows).collect())
