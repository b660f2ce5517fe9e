from listwarden.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def _judged(spark, urls, listed=(), max_blocks=1 << 16):
    pages = spark.createDataFrame([(k, u, "r", "h") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    lists = spark.createDataFrame([(x,) for x in listed], "canonical string")
    return {r.page_id: r for r in url_filter.judge(pages, rules, lists, max_blocks).collect()}


def test_rules_and_odd_urls(spark):
    urls = [
        "http://a.Example.COM/en/x", "http://www.example.com/en/", "http://example.com", "http://example.com?/en/", "http://xexample.com/en/", None, "no scheme", "",
        "ftp://b.net/es/?q=://com/", "http://net/es", "http://a.org/", "http://a.org/", "x" * 100_000 + "://com/" + "y" * 100_000,
    ]
    got = _judged(spark, urls)
    assert [(got[k].rule, got[k].verdict) for k in range(len(urls))] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
        ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"),
    ]
    assert (got[0].host, got[0].path) == ("a.example.com", "/en/x") and (got[5].host, got[5].path) == ("", "") and got[3].path == ""


def test_list_is_exact_however_full_the_filter_is(spark):
    urls = [f"https://www.a{k % 50}.org/p{k}/?ref=z&utm_x=1" for k in range(400)]
    listed = [f"a{k % 50}.org/p{k}" for k in range(0, 400, 3)]
    got = _judged(spark, urls, listed, max_blocks=1)
    assert [got[k].verdict for k in range(400)] == ["block" if k % 3 == 0 else "allow" for k in range(400)]
    assert got[0].canonical == "a0.org/p0"


def test_empty_table(spark):
    assert _judged(spark, []) == {}
