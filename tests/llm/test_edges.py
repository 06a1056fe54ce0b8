"""Text borders, adversarial texts, clashing names, shared templates, and brute-force versions of what SQL can't say."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_text_operators import plain_rules
from test_token_operators import whole

import corpus_pipeline
from ravelin.llm import html_extraction, quality_classifier, quality_rules, quote_linking, secrets, simhash
from ravelin.llm.base import scratch_path
from ravelin.llm.tokens import encoder

_PARTS = st.lists(
    st.sampled_from(["foo", "bar", " ", "\n", "\n\n", "  ", "\t", "é", "'s", ".", ",", "ß", "1", "A", " ", "\r\n", "don't", "x/y"]),
    max_size=6
).map("".join)


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=60, deadline=None)
@given(st.lists(_PARTS, max_size=8))
def test_batches_give_the_ids_of_single_texts(vocabulary, texts):
    assert [x.tolist() for x in encoder(vocabulary).encode_all(texts)] == [whole(vocabulary, t) for t in texts]


def test_long_and_hostile_texts_take_little_time():
    began = time.perf_counter()
    for t in ("a1" + "-" * 100_000 + "1a1a", "a1-" * 40_000 + "x", "password" + " " * 100_000, "/".join(["production", "a" * 19] * 5_000)):
        secrets.scan(t)
    weights = html_extraction.Weights({}, {})
    for page in (
        "<a " * 20_000, '<a "' * 20_000, "<div>" * 20_000 + "</p>" * 20_000, "<b>" * 20_000 + "<div></div>" * 20_000, "<!-" * 20_000,
        "<script " * 20_000
    ):
        html_extraction.extract(page, weights)
    assert time.perf_counter() - began < 20


def test_shared_template_lines_count_documents(spark):
    rng = random.Random(17)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    template = " ".join(f"template word {chr(97 + k)}" for k in range(20))
    rows = [(i, f"the header of the host\n{own(60)}\nthe footer of the host", "h") for i in range(60)]
    rows += [(100 + i, f"the header of the host\n{own(5)}\n{template}\nthe footer of the host", "h") for i in range(40)]
    docs = spark.createDataFrame(
        [(i, t, "en", s, len(t), 1, 2, 3) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long, _cut int, _kept_id int, clean int"
    )
    kept = quality_rules.clean_documents(docs).collect()
    assert {r["doc_id"] for r in kept} == set(range(60)) and not any("header" in r["text"] or "footer" in r["text"] for r in kept)
    assert {(r["_cut"], r["_kept_id"], r["clean"]) for r in kept} == {(1, 2, 3)}
    got = quality_rules.judge(docs).select("doc_id", "kept", "n_removed_words").collect()
    assert Counter(map(tuple, got)) == Counter(
        (x[0], x[7], x[8]) for x in plain_rules([(i, t, None, s) for i, t, s in rows], quality_rules.MAX_HOST_DOCS)
    )


def test_clashing_names_and_maps(spark):
    text = " ".join(f"word{k}" for k in range(80))
    docs = spark.createDataFrame(
        [(i, text, 5, 6, {"a": i}, "t") for i in (3, 2, 2, 9)] + [(7, "another text", 5, 6, None, "t")],
        "doc_id long, text string, _n int, _keep_id int, m map<string,int>, _clean_text string"
    )
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 7]
    assert {r["_clean_text"] for r in secrets.redact(docs).collect()} == {"t"}


def test_pipeline_on_an_empty_table(spark):
    base = scratch_path(spark, "sf")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{base}/documents.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0


# --- classifier


def plain_score(text, weights):
    """The score from a dictionary of features, one at a time."""
    words = re.findall(r"[^\W_]+|[^\w\s]+|_+", text)
    if not words:
        return 1 / (1 + math.exp(-weights[0]))
    token = [zlib.crc32(w.encode()) for w in words]
    form = [6 if k and token[k] == token[k - 1] else quality_classifier._form(w) for k, w in enumerate(words)]
    slot = lambda x, salt: ((x % (1 << 64) * (0x9E3779B97F4A7C15 + 2 * salt) % (1 << 64)) >> 40) % (quality_classifier.DIM - 1) + 1
    feature = defaultdict(float)
    for x in token:
        feature[slot(x, 1)] += quality_classifier.SCALES[0] / len(words)
    for a, b in zip(token, token[1:], strict=False):
        feature[slot((a * 0x1F123BB5) ^ b, 2)] += quality_classifier.SCALES[0] / len(words)
    for a, b in zip(form, form[1:], strict=False):
        feature[slot(a * 64 + b, 3)] += quality_classifier.SCALES[1] / len(words)
    return 1 / (1 + math.exp(-(weights[0] + sum(weights[k] * v for k, v in feature.items()))))


def test_scores_are_sparse_dot_products():
    rng = random.Random(3)
    weights = np.random.default_rng(3).standard_normal(quality_classifier.DIM)
    for _ in range(50):
        text = " ".join(rng.choice(["Good", "bad", "bad", "12", "!!", "a_b", "É", "don't", "MIT"]) for _ in range(rng.randrange(30)))
        assert quality_classifier.score(text, weights) == pytest.approx(plain_score(text, weights), rel=1e-9)


def test_ftrl_against_plain_updates():
    rng = random.Random(5)
    model, z, n = quality_classifier.Ftrl(16), [0.0] * 16, [0.0] * 16
    q = quality_classifier
    for _ in range(200):
        at = sorted(rng.sample(range(16), 4))
        value, label = [rng.uniform(-1, 1) for _ in at], float(rng.randrange(2))
        w = [0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, value, strict=True))))
        for i, wi, v in zip(at, w, value, strict=True):
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * wi
            n[i] += g * g
        model.update(np.array(at), np.array(value), label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_repeated_ids_train_alike(spark):
    rows = [(i, f"text {k} " + ("fine words here " if i % 2 else "spam now !! ") * 8) for i in range(40) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    first = quality_classifier.train(docs.repartition(5, "text"), labels)
    assert np.array_equal(first, quality_classifier.train(docs.orderBy(F.desc("text")), labels)) and (first != 0).any()


# --- pages


def best_runs(page, weights):
    """Every run of events with the greatest sum."""
    scores = [len(v.split()) * weights.word(e) if k == "text" else weights.tag(v, e) for k, v, e in html_extraction.events(page)]
    sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
    most = max(sums.values(), default=0.0)
    return [r for r, s in sums.items() if abs(s - most) < 1e-9] if most > 0 else []


def words_between(page, run):
    found = list(html_extraction.events(page))[run[0] : run[1]]
    return " ".join(v for k, v, e in found if k == "text" and not e.aside).split()


def test_the_region_is_the_best_run():
    rng = random.Random(7)
    weights = html_extraction.Weights({"p": 1.5, "li": 0.2, "div": -1.2, "div.x": -0.6}, {"p": -0.1, "div": -2.0, "li": -0.7})
    for _ in range(60):
        page = "".join(
            rng.choice(
                [
                    "<p>one two</p>", "<div>menu", "</div>", "<li>item</li>", "<div class='x'>note", "<b>bold</b>", "<br>", "</p>",
                    "tail words here "
                ]
            )
            for _ in range(rng.randrange(1, 14))
        )
        got = "".join(html_extraction.extract(page, weights).split())  # inline tags leave no space
        runs = best_runs(page, weights)
        assert got == "" if not runs else got in ["".join(words_between(page, r)) for r in runs]


def test_without_the_scan_the_text_is_wrong():
    page = "<html><body><div class='cookie-bar'>We use cookies</div><ul class='menu-top'><li>Home</li></ul><article><p>The words of the text itself.</p></article><div class='side'>Other news</div></body></html>"
    counts = defaultdict(lambda: [0, 0])
    for _ in range(5):
        html_extraction.count_page(page, counts)
    weights = html_extraction.Weights(
        {k: math.log((i + 1) / (o + 1)) for (kind, k), (i, o) in counts.items() if kind == "word"},
        {k: min(-0.05, math.log((i + 1) / (o + 1))) for (kind, k), (i, o) in counts.items() if kind == "tag"}
    )
    assert html_extraction.extract(page, weights) == "The words of the text itself."
    assert words_between(page, (0, len(list(html_extraction.events(page))))) != "The words of the text itself.".split()


# --- quotes


def plain_links(rows):
    """The message that each passage links to, by comparing with every message."""
    norm = lambda t: " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in t).split())
    parts = lambda t: [x for x in re.split(r"\n[^\S\n]*\n", t) if x.strip()]
    own = {(c, t): quote_linking.parse(x or "")[0] for c, t, x in rows}
    units = {k: {norm(u) for u in [x, *parts(x), *x.split("\n")] if u.strip()} for k, x in own.items()}
    links = {}
    for c, t, x in rows:
        for pos, (level, lines) in enumerate(quote_linking.parse(x or "")[1]):
            whole_text = "\n".join(lines)
            asked = [(0, norm(whole_text)), *((1, norm(p)) for p in parts(whole_text)), *((2, norm(p)) for p in lines if p.strip())]
            best = None
            for unit, n in asked:
                near = [k for k in units if k[0] == c and n in units[k]]
                far = [k for k in units if n in units[k]]
                if near and min(near)[1] < t:
                    best = min(filter(None, [best, (unit, 0, min(near))]))
                elif unit == 0 and far and min(far)[0] < c:
                    best = min(filter(None, [best, (unit, 1, min(far))]))
            if best:
                links[c, t, pos] = (level, best[2])
    return links


def test_quote_links_against_all_messages(spark):
    rng = random.Random(13)
    say = lambda: " ".join(rng.choice("ja nein gut then Thanks ok red blue green sun".split()) for _ in range(rng.randrange(1, 5)))
    rows, texts = [], []
    for c in range(12):
        for t in range(rng.randrange(1, 9)):
            lines = []
            if texts and rng.random() < 0.7:
                quoted = rng.choice(texts).split("\n")
                a = rng.randrange(len(quoted))
                lines += ["On Monday someone wrote:"] * rng.randrange(2) + [
                    rng.choice(["> ", ">", ">> "]) + x.upper() for x in quoted[a:] if not x.startswith(">")
                ]
            lines += [say() for _ in range(rng.randrange(1, 3))] + (["", say()] if rng.random() < 0.4 else [])
            rows.append((c, t, "\n".join(lines)))
            texts.append(rows[-1][2])
    want = plain_links(rows)
    assert len(want) > 10 and any(k[0] != v[1][0] for k, v in want.items())
    got = quote_linking.reply_order(
        spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    ).collect()
    parents, linked = {}, Counter(k[:2] for k in want)
    for (c, t, pos), (level, to) in want.items():
        parents[c, t] = min(parents.get((c, t), (level, pos, to)), (level, pos, to))
    turns = {(c, t) for c, t, _ in rows}
    for r in got:
        at = (r["conv_id"], r["turn"])
        before = (at[0], at[1] - 1) if (at[0], at[1] - 1) in turns else (None, None)
        assert (r["parent_conv"], r["parent_turn"]) == (parents[at][2] if at in parents else before)
        assert r["n_linked"] == linked[at]
        assert "wrote:" not in r["own_text"]


def test_paragraphs_of_a_wrapped_quote_link(spark):
    rows = [
        (1, 0, "First paragraph that is long.\n\nSecond paragraph\nis long too.\n\nThird one."), (1, 1, "something else"),
        (1, 2, "> First paragraph\n> that is long.\n>\n> Second paragraph is long\n> too.\nyes"), (2, 0, "Thanks"),
        (3, 0, "> Thanks\n> but this was said nowhere\nno")
    ]
    got = {
        (r["conv_id"], r["turn"]): r
        for r in quote_linking.reply_order(
            spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
        ).collect()
    }
    assert got[1, 2]["parent_turn"] == 0 and got[3, 0]["parent_conv"] is None
