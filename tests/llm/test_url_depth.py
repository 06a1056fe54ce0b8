"""Listed URLs of many segments and labels; an entry without a closing slash stands for itself."""

from ravelin.llm import url_filter


def test_deep_entries(spark):
    listed = ["deep.com/a/b/c/d/", "slash.com/a/b", "s.t.u.v.w.x.long.com", "deep.com/a/b/c/d/e/f/g/h/i/j/only", "org.com/x/"]
    urls = {
        "http://deep.com/a/b/c/d/e": "deep.com/a/b/c/d/",
        "http://deep.com/a/b/c/d/e/f/": "deep.com/a/b/c/d/",
        "http://deep.com/a/b/c/x/d/e": None,
        "http://www.deep.com//a/b//c/d/e?q": "deep.com/a/b/c/d/",
        "http://slash.com/a/b": "slash.com/a/b",
        "http://slash.com/a/b/": None,
        "http://slash.com/a/b/c/d": None,
        "http://slash.com/a/bc": None,
        "http://slash.com/a": None,
        "http://r.s.t.u.v.w.x.long.com/p/q": "s.t.u.v.w.x.long.com/",
        "http://t.u.v.w.x.long.com/": None,
        "http://" + "a." * 300 + "deep.com/" + "a/b/c/d/" * 200: "deep.com/a/b/c/d/",
        "http://org.com/x": None,
        "http://org.com": None,
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for blocks in (1, 1 << 16):
        got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed, rules=[], blocks=blocks).collect()}
        assert [got[i]["listed"] for i in range(len(urls))] == list(urls.values())
        assert all((r["verdict"] == "block") == (r["listed"] is not None) for r in got.values())


def test_written_differently(spark):
    listed = ["spam.org/", "HTTP://User@Ads.com:8080/a/%62/", "deep.com/x/y"]
    urls = {
        "http://spam.org:80/x": "spam.org/",
        "http://u@spam.org/x": "spam.org/",
        "http://u:p@www.spam.org.:443": "spam.org/",
        "http://sp%61m.org/": "spam.org/",
        "http://SPAM.org": "spam.org/",
        "http://spam.org.evil.com/": None,
        "http://evil.com/spam.org/": None,
        "http://evil.com@spam.org/": "spam.org/",
        "http://spam.org@evil.com/": None,
        "http://ads.com/a/b/c": "ads.com/a/b/",
        "http://ads.com/z/../a/./b/": "ads.com/a/b/",
        "http://ads.com/%61//b/c/..": "ads.com/a/b/",
        "http://ads.com/a/b": None,
        "http://ads.com/a/b/../c": None,
        "http://deep.com/x/q/../y": "deep.com/x/y",
        "http://deep.com/../../x/y": "deep.com/x/y",
        "http://deep.com/x/y/.": None,
        "http://deep.com/x%2Fy": "deep.com/x/y",
        "http://deep.com/x/%zz/../y": "deep.com/x/y",
        "http://deep.com/x+y": None,
        "http://@:80/x": None,
        "http://": None,
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed, rules=[]).collect()}
    assert {u: got[i]["listed"] for i, u in enumerate(urls)} == urls
    assert got[0]["host"] == "spam.org:80" and got[10]["path"] == "/z/../a/./b/"


def test_filter_grows_with_the_list(spark):
    listed = spark.range(40_000).selectExpr("concat('h', id, '.org/') AS url")
    pages = spark.range(500).selectExpr("id AS page_id", "concat('http://h', id * 160, '.org/p') AS url")
    got = url_filter.judge_urls(pages, listed, rules=[]).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] * 160 < 40_000) for r in got)
