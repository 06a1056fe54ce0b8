"""Token files, packing, classifier, pages, quotes and URLs."""

import html
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ravelin.llm import html_extraction, packing, quality_classifier, quote_linking, token_files, url_filter
from ravelin.llm.base import scratch_path
from ravelin.llm.tokens import encoder

TRICKY = [
    "", " ", "  a", "a  b", "\n\n  bar", "foo\n\n bar", "foo\nBar. Baz \n bar  ", "x  y", "é ́a b", "don't 'tis it's", "a\x1c b", "日本 語 b",
    "Aİ ΣΣ bΣ c", "a\u3000 b", "1 2  3\t 4 \t5", "<|endoftext|> a<|endoftext|>b", "\u180e a \u200b b \x85 c", "a \x01 b\x01 c", "\n",
    "word,next é. né,\u00d7, x\u00f7! it's.'s (a) a***b##\n**c U.S.A. naïve? \u0301, e\u0301, \u00a0.", None
]


def whole(vocabulary, text):
    t = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_words_give_the_ids_of_whole_texts(vocabulary, messy_rows):
    texts = [*TRICKY, *[r[1] for r in messy_rows]]
    for _ in range(2):  # unseen words, then known ones
        got = encoder(vocabulary).encode_all(texts)
        assert [x.tolist() for x in got] == [whole(vocabulary, t) for t in texts]
    assert encoder(vocabulary).encode_all([]) == []


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300),
    st.sampled_from([1, 7, 64, 1024])
)
def test_simple8b_round_trip(ids, block):
    ids = np.array(ids, np.uint64)
    assert token_files.decode(token_files.encode(ids, block)[0]).tolist() == ids.tolist()
    file = token_files.TokenFile(token_files.pack_file([ids[:5], ids[5:]], block))
    assert file.ids().tolist() == ids.tolist()
    assert file.ids(3, 40).tolist() == ids[3:40].tolist()


def test_token_files(spark, messy, messy_rows, empty):
    path = scratch_path(spark, "files")
    token_files.write_files(messy, path, file_ids=2000)
    assert spark.read.parquet(path).count() > 3
    got = token_files.read_files(spark, path).collect()
    want = Counter()
    for r in messy_rows:
        ids = whole(token_files.VOCABULARY, r[1])
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    names = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert names == sorted(names)
    path = scratch_path(spark, "files")
    token_files.write_files(empty, path)
    assert token_files.read_files(spark, path).count() == 0


def test_hilbert_curve_visits_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert_key(points, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing(messy, messy_rows, empty):
    got = packing.pack(messy, length=256).collect()
    ids = defaultdict(list)
    for r in messy_rows:
        ids[r[0]].append(whole(packing.VOCABULARY, r[1]))
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:  # each piece is a slice of a document of its id
        assert any(
            len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            for x in ids[r["doc_id"]]
        )
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    full = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        full += at == 256
    assert full >= len(sequences) - 4  # one short sequence for each partition at most
    assert packing.pack(empty).count() == 0


def test_neighbours_on_the_curve_are_alike():
    near, other = "red green blue " * 40, "seven eight nine ten " * 40
    points = [packing.grid_point(np.array(whole(packing.VOCABULARY, t))) for t in (near, near + "red", other)]
    apart = lambda a, b: int(np.abs(a - b).sum())
    assert apart(points[0], points[1]) * 5 < apart(points[0], points[2])


def test_classifier(spark, messy, messy_rows, empty):
    rows = [(i, ("spam!! buy!! now!! " if i % 3 == 0 else "a calm sentence about rivers and hills ") * 12 + str(i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i % 3 != 0)) for i in range(600)] + [(None, 1), (3, None), (99_999, 0)], "doc_id long, quality int"
    )
    weights = quality_classifier.train(docs, labels)
    got = quality_classifier.score_documents(docs, weights).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) >= 0.98 * len(held) > 0
    # Labels of held-out rows change nothing.
    flipped = spark.createDataFrame(
        [(i, int((i % 3 != 0) != (zlib.crc32(str(i).encode()) % 5 == 0))) for i in range(600)], "doc_id long, quality int"
    )
    assert np.allclose(quality_classifier.train(docs, flipped), weights)
    scored = quality_classifier.score_documents(messy, weights).collect()
    assert len(scored) == len(messy_rows) and all(0 <= r["score"] <= 1 for r in scored)
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score_documents(messy, none).collect()} == {0.5}
    assert quality_classifier.score_documents(empty, weights).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T words</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head><body>'
    "<header><h2>Site name</h2></header><nav><ul><li><a href='/a'>Home page</a></li></ul></nav><!-- no <p>comment</p> -->"
    '<div class="cookie-notice">We use cookies here</div><article><h1>The&nbsp;title &amp; more</h1><p>First <b>bold</b>\n  words<br>here.<p>Second &lt;para&gt;.'
    '<div class="ad">Buy it now</div><aside class="sidebar"><p>{side}</p></aside><p>Third.</p><form><p>Your mail</p><button>Send</button></form>'
    '<section id="comments"><p>Nice article</p></section></article><footer>&copy; someone</footer></body></html>'
)


def test_html_extraction(spark):
    page = PAGE.replace("{side}", "side words " * 200)
    rows = [(i, "u", page.replace("Second", f"Second{i}"), "x") for i in range(30)] + [
        (30, None, None, "x"), (31, "u", "", "x"), (31, "u", "", "x"), (None, "u", "<p>only", "x"), (33, "u", "<!-- open <p>x</p>", "x"),
        (34, "u", "<p>" + "w " * 50_000, "x")
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = html_extraction.fit(pages)
    got = {}
    for r in html_extraction.extract_pages(pages, weights).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    for i in range(30):
        assert got[i] == [f"The title & more\n\nFirst bold words here.\n\nSecond{i} <para>.\n\nThird."]
    assert got[30] == [""] and got[31] == ["", ""] and got[None] == ["only"] and got[33] == [""]
    assert got[34] == [" ".join(["w"] * 50_000)]
    bare = html_extraction.Weights({}, {})  # no labelled pages: default weights
    assert "Third." in html_extraction.extract(page, bare) and "cookies" not in html_extraction.extract(page, bare)
    assert html_extraction.extract_pages(pages.limit(0), html_extraction.fit(pages.limit(0))).count() == 0
    assert html.unescape("&amp;") == "&"


def test_quote_linking(spark):
    rows = [
        (1, 0, "user", "Hello there friend\nhow are you"), (1, 1, "a", "> hello  There friend\n> how are you\nI am fine.\n\nAnd you?"),
        (1, 2, "user", "> I am fine.\nGreat"), (1, 3, "a", ">> hello there friend\n> and you?\nok"), (2, 0, "user", "> Great\nnew thread"),
        (2, 1, "x", None), (2, 1, "x", "dup"), (None, 3, "y", ">z")
    ]
    rows += [(9, t, "user", f"turn {t}") for t in range(2500)]  # one long conversation
    messages = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv int, hash int")
    got = quote_linking.reply_order(messages).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert (by[1, 3]["parent_turn"], by[1, 3]["depth"], by[1, 3]["n_linked"], by[1, 3]["max_level"]) == (1, 2, 2, 2)
    assert (by[2, 0]["parent_conv"], by[2, 0]["parent_turn"], by[2, 0]["thread_conv"]) == (1, 2, 1)
    assert by[1, 1]["own_text"] == "I am fine.\n\nAnd you?" and by[None, 3]["own_text"] == ""
    assert all(by[9, t]["depth"] == t and by[9, t]["thread_turn"] == 0 for t in range(2500))
    assert quote_linking.reply_order(messages.limit(0)).count() == 0


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://EXAMPLE.net/en/x", "http://a.example.net/de/", "https://example.com/de/1?x#y",
        "https://notexample.com/de/1", "http://x.org/fr/", "http://x.org?/fr/", "http://spam-farm.example.org",
        "http://www.SPAM-farm.example.org/a//b?c", "http://xspam-farm.example.org/", "http://net", "a://b://net/",
        "http://x.com/p/q/r/s/t/u/v", "http://x.com/p/q", "http://x.com/p/qq", "http://x.com/p/q",
        "http://" + "a." * 300 + "x.com/" + "p/" * 300
    ]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = [*url_filter.LISTED, "x.com/p/q"]
    for blocks in (1, 1 << 16):  # a filter that is full lets more pass, and the join removes it
        got = {
            r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
            for r in url_filter.judge_urls(pages, listed, blocks=blocks).collect()
        }
        assert len(got) == len(urls)
        for i in (0, 1, 2):
            assert got[i] == ("", "", None, "allow")
        assert got[3] == ("example.net", "/en/x", "example.net/en/", "allow") and got[4][2:] == ("net/", "block")
        assert got[5] == ("example.com", "/de/1", "example.com/de/", "block") and got[6][2:] == (None, "allow")
        assert got[7][2:] == ("org/fr/", "allow") and got[8] == ("x.org", "", None, "allow")
        assert got[9][3] == "block" and got[10] == ("www.spam-farm.example.org", "/a//b", None, "block") and got[11][3] == "allow"
        assert got[12] == ("net", "", None, "allow") and got[13][0] == "b:"
        assert [got[i][3] for i in (14, 15, 16, 17)] == ["allow", "block", "allow", "block"]
    assert url_filter.judge_urls(pages, []).where("listed is not null").isEmpty()
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
