import html
import re

from kestrane.llm.html_text import html_text, main_text
from kestrane.llm.queries import op8_html_extraction

LONG = "The words of this long paragraph are about nothing at all, but it is long enough to be decided by itself."


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head>
    <body class="no-sidebar"><header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></ul></nav>
    <div id="cookie-notice"><p>{LONG}</p></div><div class="ad">{LONG}</div>
    <article><header><h1>Head &amp; shoulders</h1></header><p><b>{LONG}<br>Next&nbsp;line<p>Short.</p><ul><li>one<li>two</ul>
    <form><p>{LONG}</p><input name=x></form><aside>{LONG}</aside>
    <div class="comments"><p>{LONG}</p></div><p>caf&eacute; &#x41;<!-- gone --></p></article>
    <div class="sidebar">{LONG}</div><footer>&copy; x</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["Head & shoulders", f"{LONG} Next line", "Short.", "one", "two", "café A"]


def test_without_article_neighbours_decide():
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div class=content><h2>Title</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><p><a href=z>More</a></p></body>"
    assert main_text(page).split("\n\n") == ["Title", LONG, "Yes.", LONG]


def test_links_in_the_article():
    page = f"<article><p>{LONG}</p><p>See <a href=x>the other page</a> and more.</p><ul><li><a href=y>Share this</a></li></ul></article>"
    assert main_text(page).split("\n\n") == [LONG, "See the other page and more."]


def test_empty_and_broken():
    assert main_text("") == "" and main_text("<p></p>") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("<article><p>a<div>b</article></p></div><p>") == "a\n\nb"
    assert main_text("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_query(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op8_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        assert "".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split()) == "".join(r.text.split())


def test_edges(spark):
    rows = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "y"), (1, "u", "<p>a", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_text(rows).collect()) == [("", 0), ("", 0), ("a", 1)]
    assert html_text(rows.limit(0)).count() == 0


def test_names_and_forms_round_the_text_are_no_verdict():
    rest = f'<div class="sidebar"><p>{LONG}</p></div><div class="comments-area"><p>{LONG}</p></div>'
    body = f"<h1>Head</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><p>{LONG}</p>"
    want = ["Head", LONG, "Yes.", LONG, LONG]
    for name in ("content no-sidebar", "has-sidebar", "layout-with-ads", "post-comments-open", "widget"):
        for inner in (f"<article>{body}</article>", body, f"<article>{body}</article>{rest}"):
            assert main_text(f'<body><div class="{name}">{inner}</div></body>').split("\n\n") == want, (name, inner)
    for inner in (f"<article>{body}</article>", body):
        assert main_text(f'<body><form id="aspnetForm"><input name=x>{inner}{rest}</form></body>').split("\n\n") == want
    assert main_text('<div class="social"><article><p>tiny</p></article></div>') == "tiny"


def test_text_outside_the_articles():
    page = f"<body><article><p>A teaser.</p></article><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><p><a href=x>More</a></p></div><footer>{LONG}</footer></body>"
    assert main_text(page).split("\n\n") == ["A teaser.", "Title", LONG, LONG]
    assert main_text(f"<p>Menu</p><article><p>{LONG}</p></article><p>Imprint</p>") == LONG
    assert main_text("<p>Menu</p><article><p>tiny</p></article><p>Imprint</p>") == "tiny"


def test_comments_longer_than_the_article_stay_out():
    assert main_text(f'<div><p>{LONG}</p></div><div id="comments"><p>{LONG}</p><p>{LONG}</p></div>') == LONG


def test_nothing_else_is_dropped_from_an_article():
    item = "<ul><li>see <a>this long link text here</a></li></ul>"
    assert main_text(f"<article><p>Hello world.</p>{item}<p>Short.</p></article>").split("\n\n") == ["Hello world.", "see this long link text here", "Short."]
    assert main_text(f"<article><h2>Head</h2><p><a href=x>{LONG}</a></p><p>{LONG}</p></article>").split("\n\n") == ["Head", LONG, LONG]
    assert main_text("<article><p>Hello.</p><ul><li><a href=y>Share this</a></li></ul><p>Short.</p></article>").split("\n\n") == ["Hello.", "Short."]


def test_figures_and_unknown_languages_stay():
    figures = "11 22 33 44 55.6 " * 9
    for page in (f"<div><p>{figures}</p></div>", f"<article><p>{figures}</p></article>"):
        assert main_text(page) == figures.strip()
    page = f"<div><p>{LONG}</p><table><tr><td>{figures}</td></tr></table><p>{LONG}</p></div>"
    assert main_text(page).split("\n\n") == [LONG, figures.strip(), LONG]
    other = "Þetta er texti á máli sem engin orð hér þekkja, og hann er nógu langur til að standa einn og sér."
    assert main_text(f"<ul><li><a href=x>Heim</a></li></ul><div><p>{other}</p></div><p>{other}</p>").split("\n\n")[-1] == other
    assert main_text(f"<div><p>{other}</p><p>{other}</p></div>").split("\n\n") == [other, other]


def test_unknown_words_in_names_do_not_let_comments_and_notices_through():
    other = LONG.replace("paragraph", "comment")
    for name in ('class="user-comments"', 'id="fb-comments"', 'class="comment-thread"', 'class="usercomments"', 'class="readerComments"', 'class="comments-v2"', 'class="cookie-policy-bar"', 'class="newsletter-cta"', 'id="cookiebar"', 'class="x-social-strip"'):
        part = f"<div {name}><p>{other}</p><p>{other}</p></div>"
        assert main_text(f"<body><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>{part}</body>").split("\n\n") == ["Head", LONG, LONG, LONG], name
        for page in (f"<body>{part}<article><p>{LONG}</p></article></body>", f"<body><article><p>{LONG}</p></article>{part}</body>", f"<article><p>{LONG}</p>{part}<p>Short.</p></article>"):
            assert main_text(page).split("\n\n") in ([LONG], [LONG, "Short."]), (name, page)


def test_comments_that_are_articles_themselves():
    comments = f'<ol><li class="comment"><article id="div-comment-2" class="comment-body"><p>{LONG}</p><p>{LONG}</p></article></li></ol>'
    assert main_text(f"<article><p>{LONG}</p><p>End.</p></article>{comments}").split("\n\n") == [LONG, "End."]
    assert main_text(f'<div class="sidebar-layout"><article><p>{LONG}</p></article></div>{comments}') == LONG


def test_names_that_tell_of_the_page_or_its_topic():
    body = f"<p>{LONG}</p><p>Yes.</p>"
    side = f'<div class="x"><p>{LONG}</p><p>{LONG}</p></div>'
    for name in ("no-sidebar", "nosidebar", "has-comments", "layout-with-ads", "post-comments-open", "ad-free", "post category-social", "tag-newsletter", "page-without-cookies", "sidebar-layout"):
        assert main_text(f'<body><div class="{name}">{body}</div>{side}</body>').split("\n\n") == [LONG, "Yes.", LONG, LONG], name
    assert main_text(f'<article><p class="social-history">{LONG}</p><h2 class="menu-of-the-day">Soup</h2><p>{LONG}</p></article>').split("\n\n") == [LONG, "Soup", LONG]
    assert main_text(f'<article class="post has-comments"><p>{LONG}</p></article>') == LONG
