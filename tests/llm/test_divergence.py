"""Divergences of sources against plain Python, on crowded and messy tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ravelin.llm import divergence


def plain(rows, least=10, top=10):
    """``rows``: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    groups = {(lang, source) for _, lang, source in rows}
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def p(own, kept=kept):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in sources if o != s]
            more = [(t, f(ps[s][t], q[t])) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", more, top)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("tile", [64, 3])
def test_equals_plain_sums(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    rng = random.Random(tile)
    vocabulary = ["the", "The", "Éa", "éa", "straße", "x1y", "ab_c", "日本", "naïve", *(f"w{chr(97 + k)}" for k in range(26))]
    rows = []
    for _ in range(600):
        source = f"s{rng.randrange(15)}" if rng.random() < 0.7 else "hot"
        words = rng.choices(vocabulary[: 5 + len(source) * rng.randrange(1, 8)], k=rng.randrange(0, 30))
        rows.append((rng.choice([" ", "\n", "7", "--"]).join(words), rng.choice(["en", "de", "fr"]), source))
    rows += [("rare", "es", "only"), ("", "en", "without terms"), ("123", "it", "a"), (None, "it", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert rows_of(divergence.divergence(docs)) == plain(rows)


def test_messy_and_empty_tables(spark, messy, messy_rows, empty):
    assert rows_of(divergence.divergence(messy, min_docs=2)) == plain([r[1:4] for r in messy_rows], 2)
    assert divergence.divergence(empty).count() == 0


def test_long_texts_and_small_slices_change_nothing(spark, monkeypatch):
    rows = [("word " * 5_000 + f"other{'abc'[k % 3]} " * 50, "en", f"s{k % 2}") for k in range(20)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.divergence(docs)) == plain(rows)
    assert [w for piece in divergence.terms("Ab cd" * 600_000) for w in piece] == [b"ab"] + [b"cdab"] * 599_999 + [b"cd"]


def test_counts_beyond_64_bits_of_a_product(spark):
    row = spark.range(1).select(divergence._p(divergence.F.lit(10**15), divergence.F.lit(3 * 10**15), divergence.F.lit(7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**15 + 2) // (3 * 10**15 + 14)
