"""Hosts with several templates, and layout words in class names."""

from test_html import _texts

LONG = "story {k} goes on and on " * 20
WITH = "<html><body><nav><a href='/'>Home</a></nav><article><h1>A {k}</h1><p>" + LONG + "</p></article><div class='ad'>Buy</div></body></html>"
PLAIN = "<html><body><nav><a href='/'>Home</a></nav><div id='content'><h2>B {k}</h2><p>" + LONG + "</p></div><div class='ad'>Buy</div></body></html>"
OTHER = "<html><body><div id='page'><div class='left'><a href='/'>Home</a></div><section class='text'><h2>C {k}</h2><p>" + LONG + "</p><p>more {k}</p></section></div></body></html>"


def test_every_template_of_a_host_gives_its_text(spark):
    for url in ("http://two.org/x", None):
        pages = [(k, (WITH, PLAIN, PLAIN, OTHER, WITH, WITH)[k % 6]) for k in range(18)]
        got = _texts(spark, [(k, url, page.format(k=k)) for k, page in pages])
        for k, page in pages:
            head = {WITH: "A", PLAIN: "B", OTHER: "C"}[page]
            assert got[k][0] == f"{head} {k}\n{LONG.format(k=k).strip()}" + (f"\nmore {k}" if page is OTHER else "")


def test_layout_words_leave_no_content_out(spark):
    forms = [
        "<html><body class='no-sidebar'><article><p>{t}</p></article></body></html>", "<html class='nav'><body><div class='has-nav content'><article><p>{t}</p></article></div></body></html>",
        "<html><body><article class='post comments-open comments'><p>{t}</p></article></body></html>", "<html><body><main id='search'><p>{t}</p></main></body></html>",
        "<html><body><article><p class='notice-text'>{t}</p></article></body></html>",
    ]
    rows = [(10 * f + k, f"http://h{f}.org/", form.format(t=LONG.format(k=k))) for f, form in enumerate(forms) for k in range(3)]
    got = _texts(spark, rows)
    assert all(got[10 * f + k][0] == LONG.format(k=k).strip() for f in range(len(forms)) for k in range(3))


def test_compound_words_go_by_what_they_hold(spark):
    page = "<article><p>{t}</p><div class='cookie-banner'>We use cookies</div><div class='related-posts'><a href='/{k}'>Read {k}</a></div><div class='ad'>Buy {k}</div></article>"
    got = _texts(spark, [(k, "http://h.org/", page.format(k=k, t=LONG.format(k=k))) for k in range(4)])
    assert all(got[k][0] == LONG.format(k=k).strip() for k in range(4))
