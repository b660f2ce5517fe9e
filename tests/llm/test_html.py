from listwarden.llm import html_wrappers as hw

ARTICLE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body><header><a href="/">Home</a></header>'
    '<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <article>old</article> -->'
    '<article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b> two<br>three<p>Next&nbsp;&#233; line\n with  space</p>{middle}<div class="share">Share</div>'
    '<form>Name <input name="x"></form><p>Last</p><section id="comments"><p>First!</p></section></article><aside><p>Side</p></aside><div class="ad">Buy</div><footer>(c)</footer>'
)


def _texts(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    got = hw.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    return {r.page_id: (r.text, r.n_chars) for r in got.collect()}


def test_article_without_what_surrounds_it(spark):
    middle = ["", "<h2>Sub</h2><p>Body</p><h2>Sub 2</h2><p>Body 2</p>", "<ul><li>x</li><li>y</li></ul>", "<blockquote>Said</blockquote>"]
    rows = [(k, "http://h.org/x", ARTICLE.replace("{middle}", m)) for k, m in enumerate(middle)]
    rows += [(9, None, None), (10, "http://h.org/x", ""), (11, "http://h.org/y", rows[0][2] + "</body></html>"), (11, "http://h.org/y", rows[0][2])]
    got = _texts(spark, rows)
    inner = ["", "Sub\nBody\nSub 2\nBody 2\n", "x\ny\n", "Said\n"]
    for k in range(4):
        text = f"Title & more\nOne bold two three\nNext é line with space\n{inner[k]}Last"
        assert got[k] == (text, len(text))
    assert got[9] == got[10] == ("", 0) and got[11] == got[0]


def test_pages_without_an_article_by_the_heaviest_node(spark):
    page = '<html><body><div id="top"><a href="/">Home</a> <a href="/n">News</a></div><div id="text-{k}"><h2>Head {k}</h2><p>{long}</p><p>More {k}</p></div><div>Terms apply</div></body></html>'
    rows = [(k, "http://plain.net/", page.format(k=k, long=f"story {k} " * 40)) for k in range(6)]
    got = _texts(spark, rows)
    assert all(got[k][0] == f"Head {k}\n{('story ' + str(k) + ' ') * 40}".strip() + f"\nMore {k}" for k in range(6))


def test_deep_broken_and_long_pages(spark):
    deep = "<div>" * 5_000 + "deep text" + "</div>" * 5_000
    broken = "<article><p>a<p>b <i>c</article> tail <a href='x" + "<"
    long = "<article>" + "".join(f"<p>{k} &lt;b&gt;</p>" for k in range(50_000)) + "</article>"
    got = _texts(spark, [(1, "http://a.b/", deep), (2, "http://c.d/", broken), (3, "http://e.f/", long), (4, "http://g.h/", "<article>1 < 2 &notreal; &amp;amp;</article>")])
    assert got[1][0] == "deep text" and got[2][0] == "a\nb c" and got[4][0] == "1 < 2 ¬real; &amp;"
    assert got[3][0].split("\n") == [f"{k} <b>" for k in range(50_000)]


def test_inference_finds_repetitions_options_groups_and_slots():
    def told(part):
        return f"{part.sign}{'?' * part.maybe}{'+' * part.many}" + (f"={part.constant}" if part.constant else "") + (f"[{' '.join(map(told, part.kids))}]" if part.kids else "")

    one = hw.wrapper(hw.parse("<ul><li>a<li>b</ul><h2>s</h2><p>t</p><h2>u</h2><p>v</p><b>same</b>"))
    two = hw.wrapper(hw.parse("<ul><li>c</ul><i>new</i><b>same</b>"))
    assert told(one) == "[ul[li+[#]] (h2 p)+[h2[#] p[#]] b[#=same]]"
    assert told(hw.merged(one, two)) == "[ul[li+[#]] (h2 p)?+[h2[#] p[#]] i?[#=new] b[#=same]]"
    assert told(hw.Part.read(two.told())) == told(two)


def test_absorbing_equals_merging():
    pages = ["<p>a</p><p><b>b</b></p><p>c</p><p>d<i>e</i></p><p></p>", "<li><a>x</a></li><li><a>y</a>z</li><li>w</li>", "<p>a</p><p>a</p>"]
    for page in pages:
        kids = hw.parse(page)[1]
        slow = hw.wrapper(kids[0])
        for kid in kids[1:]:
            slow = hw.merged(slow, hw.wrapper(kid))
        slow.many = True
        assert hw.wrapper(["", kids]).kids[0].told() == slow.told()


def test_empty_table(spark):
    assert _texts(spark, []) == {}
