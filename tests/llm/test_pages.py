from shopwake.llm.html_text import blocks, fit_tree, kept_blocks, main_text, page_texts
from shopwake.llm.language_id import fit, host_of, page_languages

import numpy as np

ARTICLE = (
    '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- <p>no</p> -->'
    '<div class="cookie-notice">We use cookies on this site to make it better for all readers.</div><div class="ad">Buy now</div>'
    '<article><h1>Head &amp; line</h1><p><b>First\n  part &lt;x&gt;<br>goes&nbsp;on<p>Of.</p><ul><li>One <a href="x" title="a > b">link</a></li></ul>'
    '<aside>Related things</aside><blockquote>Quoted.</blockquote><form><label>Name</label><input></form></article>'
    '<section id="comments"><article class="comment"><p>I do not agree with any of this, and I say so at length here.</p></article></section>'
    '<div class="sidebar"><p>More to read from our many other pages about other things.</p></div><footer>&copy; All rights</footer></body></html>'
)
WANTED = "Head & line\n\nFirst part <x> goes on\n\nOf.\n\nOne link\n\nQuoted."


def test_article_and_nothing_else():
    assert main_text(ARTICLE) == WANTED
    assert main_text(ARTICLE[: ARTICLE.index("<aside>")]) == WANTED.removesuffix("\n\nQuoted.")
    assert [main_text(x) for x in ("", "<", "<p", "<script>never closed", "<!-- open", "</div></p>")] == [""] * 2 + [main_text("<p")] + [""] * 3


def test_pages_without_an_article_element():
    long = "It is a long sentence with many words that says a great deal about nothing in particular. " * 3
    page = f'<body><div><a href="/">Home</a></div><h2>The title</h2><p>{long}</p><p>{long}</p><div><a href="1">x</a> <a href="2">y</a></div></body>'
    assert main_text(page) == "\n\n".join(["The title", long.strip(), long.strip()])
    assert [keep for _, keep in kept_blocks(page)] == [False, True, True, True, False]


def test_wrappers_that_name_other_parts():
    long = "It is a long sentence with many words that says a great deal about nothing in particular. " * 3
    text = f"<h1>Head line</h1><p>{long}</p><p>Short one here, between the two.</p><p>{long}</p>"
    want = "\n\n".join(["Head line", long.strip(), "Short one here, between the two.", long.strip()])
    nav = '<nav><a href="/">Home</a></nav>'
    side = f'<div class="sidebar"><p>{long}</p></div>'
    for opened, closed in [
        ("<div class='content has-sidebar'>", "</div>"), ("<div class='content hasSidebar'>", "</div>"), ("<main class='no-sidebar'>", "</main>"),
        ("<article class='post with-comments'>", "</article>"), ("<article class='post tag-share'>", "</article>"), ("<main class='widget-area'>", "</main>"),
        ("<div class='sidebar-layout'><main>", "</main></div>"), ("<div id='modal-page'><div class=x><article>", "</article></div></div>"),
        ("<div class='content sidebar-left'>", "</div>"), ("<div class='with sidebar'><article>", "</article></div>"),
    ]:
        assert main_text(f"<body>{nav}{opened}{text}{closed}{side}</body>") == want, opened
    # Teasers and comments in articles of their own stay apart, and so does a list of links.
    teasers = f"<div class='related'><article><p>{long}</p></article><article><p>{long}</p></article></div>"
    assert main_text(f"<body>{nav}<article>{text}</article>{teasers}</body>") == want
    assert main_text(f"<body>{nav}<main>{text}<section id=comments><article>{long}</article></section></main></body>") == want
    assert main_text(f"<body><div class='content sidebar-left'>{text}<ul><li><a href=1>One more</a><li><a href=2>And two</a></ul></div></body>") == want


def test_wrappers_named_like_parts():
    """Named like a part, a holder of most of the page is the article; the parts in it and beside it are not."""
    long = "It is a long sentence with many words that says a great deal about nothing in particular. " * 3
    text, want = f"<p>{long}</p><p>{long}</p>", "\n\n".join([long.strip()] * 2)
    nav, foot = '<nav><a href="/">Home</a></nav>', "<footer>All rights reserved by nobody in particular here.</footer>"
    inner = f'<div class="comments"><p>{long * 3}</p></div><div class="share"><a href="1">Tell a friend</a></div>'
    side = f'<div class="sidebar"><p>{long}</p></div>'
    for opened, closed in [
        ('<div class="widget-page">', "</div>"), ('<div class="search">', "</div>"), ('<div id="form-layout">', "</div>"),
        ('<div class="share-page"><div class="inner">', "</div></div>"), ('<div class="related-page"><div class="entry">', "</div></div>"),
        ('<div class="menu-open"><section class="promo-layout">', "</section></div>"),
    ]:
        assert main_text(f"<body>{nav}{opened}{text}{closed}{foot}</body>") == want, opened
        assert main_text(f"<body>{nav}{opened}{text}<div class='ad'>{long}</div>{closed}</body>") == want, opened
    assert main_text(f"<body>{nav}<div class='search'>{text * 3}{side}</div></body>") == "\n\n".join([want] * 3)
    assert main_text(f"<body>{nav}<div class='search'>{text * 6}{inner}</div></body>") == "\n\n".join([want] * 6)
    # Beside an article, or as the smaller part of a page, it stays apart, as do notices on their own.
    assert main_text(f"<body><article>{text}</article><div class='related'>{text * 4}</div></body>") == want
    assert main_text(f"<body><p>{long}</p><p>{long}</p><div class='widget'>{text}</div></body>") == want
    assert main_text("<body><div class='cookie'>We use cookies on this site to make it better.</div></body>") == ""
    deep = "<div class='widget'>" * 30_000 + text
    assert main_text(deep) == want


def test_blocks_and_tree():
    found = blocks("<div>a <a>b c</a></div><p>d")
    assert [(b[0], b[1], b[2]) for b in found] == [("a b c", 3, 2), ("d", 1, 0)]
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    t = fit_tree(x, np.array([0, 1, 1, 0]))
    for row, label in zip(x, [0, 1, 1, 0]):
        node = t
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        assert node == label


def test_page_texts(spark):
    rows = [(1, "u", ARTICLE), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "word " * 200_000 + "</p>"), (1, "u", ARTICLE), (4, "x", "no markup & but &#x26; text &bogus;")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, blocks int")
    got = {x.page_id: x.text for x in page_texts(df).collect()}
    assert page_texts(df).count() == len(rows) and got[1] == WANTED and got[2] == got[3] == ""
    assert got[None].count("word") == 200_000
    assert page_texts(df.limit(0)).count() == 0


def test_languages(spark):
    words = {"aa": "kolu mapi tero", "bb": "xand yorr zeth", "cc": "quil brem fosk"}
    docs = [(f"{w} " * 30 + str(i), k) for k, w in words.items() for i in range(20)] + [(None, "aa"), ("text", None)]
    docs = spark.createDataFrame(docs, "text string, lang string")
    page = lambda text, lang="": f"<html{lang}><body><article><p>{text}</p></article></body></html>"
    rows = [(i, f"http://h{i % 5}.site.aa/x", page(words["aa"] * 3, ' lang="aa-XX"')) for i in range(40)]
    rows += [(100 + i, f"http://b{i}.other.bb/", page(words["bb"] * 3, " lang=bb")) for i in range(20)]
    rows += [(200, "https://h1.site.aa/empty", page("")), (201, "https://b3.other.bb/", page("?", ' lang="bb"')), (202, None, None), (203, "http://h2.site.aa/", page(words["bb"] * 9, ' lang="bb"')), (204, "x", page(words["cc"] * 3))]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, "zz", 0.0) for r in rows], "page_id long, url string, html string, lang string, p double")
    out = page_languages(df, docs)
    got = {x.page_id: x for x in out.collect()}
    assert out.count() == len(rows)
    assert all(got[i].lang == "aa" for i in range(40)) and all(got[100 + i].lang == "bb" for i in range(20))
    assert (got[200].lang, got[201].lang, got[203].lang, got[204].lang) == ("aa", "bb", "bb", "cc")
    assert 0 < got[202].probability <= 1 and got[200].host == "h1.site.aa" and got[203].declared == "bb"
    assert page_languages(df.limit(0), docs).count() == 0
    assert {x.lang for x in page_languages(df, docs.limit(0)).collect()} == {None}
    hosts = spark.createDataFrame([("https://u:p@Www.X.org:80/a?b",), ("x.org/a",), ("//y.de",), (None,)], "url string")
    assert [x.h for x in hosts.select(host_of(hosts.url).alias("h")).collect()] == ["www.x.org", "", "y.de", ""]


def test_rare_and_many_languages(spark):
    """A hot language, 220 rare ones, and one row many times over: none is left out."""
    docs = [(i, f"kolu mapi tero {i}", "hot") for i in range(4000)] + [(5000 + i, f"zyx{i} qwv{i} " * 20, f"l{i:03}") for i in range(220)] + [(9000, "many copies of it", "same")] * 700
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    langs, share, prior = fit(docs, 50)
    assert langs == ["hot", *(f"l{i:03}" for i in range(220)), "same"] and share.shape[1] == len(prior) == 222
    assert np.allclose(np.exp(prior)[[0, 1, 221]], np.array([4000, 1, 700]) / 4920)
    assert (share[:, 221] > share[:, 221].min() + 1e-9).sum() > 10  # fitted, once
    few = docs.where("lang in ('hot', 'l007')")
    pages = spark.createDataFrame([(1, "http://a.b/", f"<p>{'zyx7 qwv7 ' * 20} and so on it goes for long.</p>"), (2, "http://c.d/", f"<p>{'kolu mapi tero ' * 9}</p>")], "page_id long, url string, html string")
    assert {x.page_id: x.text_lang for x in page_languages(pages, few).collect()} == {1: "l007", 2: "hot"}
