import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm import html_text

LINE = "A sentence of the article that is long enough to be told from a menu entry, with a full stop."


def text(page):
    return html_text.main_text(page, html_text.Parser())


PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a>News</a></ul></nav>
<div id="cookie-notice">We use cookies on this site, and you can read about them in our long policy.</div>
<!-- <p>hidden</p> --><article><h1>Head &amp; line</h1><p>{LINE}<p><b>Bold
  and&nbsp;&lt;odd&gt;<br>text.</p><div class="ad">Buy now, the best offer of the year is here for you.</div><ul><li>First point</li>
<li>Second <a href="#">point</a></li></ul><form><p>Your mail address, please, so we can write.</p></form></article>
<aside><p>{LINE} Related.</p></aside><section class="comments"><article><p>{LINE} says a reader.</p></article></section>
<footer>&copy; 2020 Somebody, all rights reserved, and more words here.</footer></body></html>"""


def test_article_without_the_rest():
    assert text(PAGE).split("\n\n") == [
        "Head & line", LINE, "Bold and <odd> text.", "First point", "Second point",
    ]


def test_page_without_semantic_elements():
    menu = "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(9))
    page = f'<body><div class="menu"><ul>{menu}</ul></div><div id="x">' + f"<p>{LINE}</p>" * 4 + '</div><div class="footer">Imprint</div>'
    assert text(page).split("\n\n") == [LINE] * 4


@pytest.mark.parametrize(
    "page", ["", "<", "<p", "<script>x", "<!-- x", "</p></div>", '<a href="x', "<p title='a>b'>", "<html></html>", "&#0;&bogus;"]
)
def test_broken_pages_do_not_fail(page):
    assert isinstance(text(page), str)


def test_table_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE), (3, "v", f"<article><p>{LINE}</p></article>" + " " * 10**6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS other")
    found = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str)
    assert found == sorted(
        [(i, u, text(h or ""), len(text(h or ""))) for i, u, h in rows], key=str
    )
    assert html_text.extract(pages.limit(0)).collect() == []


def test_real_pages_keep_the_article(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [
            " ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
            for b in re.split("</?(?:p|h1)>", inside)
        ]
        assert text(r["html"]) == "\n\n".join(b for b in blocks if b)


def cut_cost(labels, scores, edges):
    cost = sum(max(0, s) if not keep else max(0, -s) for s, keep in zip(scores, labels))
    return cost + sum(c for a, b, c in edges if labels[a] != labels[b])


@settings(deadline=None, max_examples=150)
@given(st.data())
def test_cut_is_minimal(data):
    n = data.draw(st.integers(1, 7))
    scores = data.draw(st.lists(st.integers(-5, 5).map(float), min_size=n, max_size=n))
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    edges = [(a, b, float(data.draw(st.integers(0, 4)))) for a, b in pairs]
    best = min(cut_cost(labels, scores, edges) for labels in itertools.product([False, True], repeat=n))
    assert cut_cost(html_text.source_side(scores, edges), scores, edges) == pytest.approx(best)


SENTENCE = "The river rose by two metres in the night, and the people of the valley moved to the hills. "


@pytest.mark.parametrize(
    "tag",
    ["<svg width='1'/>", "<math/>", "<svg>", "<object data='x'>", "<select><option>one", "<datalist id='d'>", "<template>",
     "<noscript>", "<svg><title>icon</title><style/></svg>", "<object data='x'/>"],
)
def test_what_follows_an_unclosed_element_stays(tag):
    for after in ("", "<nav><svg></svg><object></object><select></select><template></template><noscript></noscript></nav>"):
        page = f"<body><article><p>First. {SENTENCE}</p>{tag}<p>Second. {SENTENCE * 3}</p></article>{after}</body>"
        text = html_text.main_text(page, html_text.Parser())
        assert "First." in text and "Second." in text and "icon" not in text


def test_closed_elements_are_skipped_and_formulas_kept():
    page = f"<article><p>{SENTENCE}</p><svg><title>icon</title><p>in</p></svg><select><option>one<option>entry</select>"
    page += f"<p>{SENTENCE} So <math><mi>x</mi><mo>=</mo><mn>42</mn></math> holds.</p></article>"
    text = html_text.main_text(page, html_text.Parser())
    assert "So x=42 holds." in text
    assert not any(word in text for word in ("icon", "entry", "in\n\n"))


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-comments", "layout sidebar-left", "search-page"])
@pytest.mark.parametrize("element", ["article", "main"])
def test_names_of_a_wrapper_do_not_outweigh_the_article(name, element):
    page = f"<body><div class='{name}'><{element}><p>{SENTENCE * 3}</p></{element}><div class='sidebar'>Links</div></div></body>"
    text = html_text.main_text(page, html_text.Parser())
    assert "The river rose" in text and "Links" not in text


def test_hidden_and_boilerplate_elements_still_outweigh_an_article():
    for opened, closed in (("<div hidden>", "</div>"), ("<aside>", "</aside>"), ("<div style='display:none'>", "</div>")):
        page = f"<body><article><p>{SENTENCE * 3}</p></article>{opened}<article><p>Hidden. {SENTENCE}</p></article>{closed}</body>"
        assert "Hidden." not in html_text.main_text(page, html_text.Parser())


@pytest.mark.parametrize("name", ["comments", "related-posts"])
def test_lists_of_other_articles_count_only_without_an_article_before(name):
    inside = f"<div class='{name}'><article><p>Inside. {SENTENCE * 3}</p></article></div>"
    before = f"<article><p>Before. {SENTENCE * 3}</p></article>"
    assert "Inside." in html_text.main_text(f"<body>{inside}</body>", html_text.Parser())
    assert "Inside." not in html_text.main_text(f"<body>{before}{inside}</body>", html_text.Parser())


STORY = "<h1>On engines</h1><p>" + " ".join(["The engine looks for words in the index and ranks what it finds by weight."] * 8) + "</p>"
PLAIN_STORY = "On engines\n\n" + " ".join(["The engine looks for words in the index and ranks what it finds by weight."] * 8)


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="story search-engines">{STORY}</div>',
        f'<div class="related-work post">{STORY}</div>',
        f'<div id="social-history">{STORY}</div>',
        f"<div class=search-results-for-you>{STORY}</div>",
        f"<div title=it's>{STORY}</div><!-- it's -->",
        f"<!-->{STORY}",
        f"<!--->{STORY}",
        f"<!-- a > b --!>{STORY}<!-- never closed <p>x</p>",
        f'<div data-x="a > b">{STORY}</div>',
    ],
)
def test_the_article_stays(page):
    """Listed words inside longer names, apostrophes in values without quotes, the short forms of comments."""
    assert html_text.main_text(f"<html><body>{page}</body></html>", html_text.Parser()) == PLAIN_STORY


@pytest.mark.parametrize("name", ["site-search", "cookie-banner", "post-comments", "comment_list", "nav-menu", "sidebar", "related-links"])
def test_names_of_other_parts(name):
    """Short texts under a listed word, and remarks of readers of any length, go."""
    text = "I liked this text very much, and I read all of it. " * 6 if "comment" in name else "Search our site for more."
    page = f'<body><article>{STORY}</article><div class="{name}"><p>{text}</p></div></body>'
    assert html_text.main_text(page, html_text.Parser()) == PLAIN_STORY
