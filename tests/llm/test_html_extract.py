import html
import re

import numpy as np
from pyspark.sql import functions as F

from cohortry.llm.html_extract import best_region, extract, fit, main_text
from cohortry.llm.labelled_pages import PAGES

MODEL = fit(PAGES)


def test_best_region_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 40):
        for _ in range(20):
            scores = rng.integers(-4, 4, n).astype(float)
            a, b = best_region(scores)
            best = max([0.0, *(scores[i:j].sum() for i in range(n) for j in range(i + 1, n + 1))])
            assert scores[a:b].sum() == best


def test_labelled_pages_come_back():
    for page in PAGES:
        marked = " ".join(" ".join(re.findall("⟦(.*?)⟧", re.sub(r"<(?!a |/a|em|/em)[^>]*>", " ", page))).split())
        assert main_text(re.sub("[⟦⟧]", "", page), MODEL) == html.unescape(re.sub(r"<[^>]*>", "", marked))


def test_parts_inside_and_around_an_article():
    page = (
        '<body class="with-sidebar"><header>Site</header><script>var t="</p><article>x";</script><form><p>Search here</p></form>'
        "<main><article><h1>Title &amp; more</h1><p>One<b>two</b> three&nbsp;\n four<br>five</p>"
        '<div class="notice">Old browser</div><aside>Aside words</aside><p>Of.</p><style>p{}</style><p>a &lt; b &#8364;5 AT&amp;T &am</p></article></main>'
        '<section class="comments"><article class="comment"><p>Nice text indeed, thank you for it.</p></article></section><footer>End</footer></body>'
    )
    assert main_text(page, MODEL) == "Title & more Onetwo three four five Of. a < b €5 AT&T &am"


def test_edge_cases(spark):
    long = "<article>" + "<p>word and word</p>" * 50_000 + "</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, long), (None, "v", "<p>plain words in a row"), (4, "w", "no markup at all"), (5, "x", "<nav><a href=x>only menu"), (6, "y", "<article><p>cut off <b>he"), (6, "y", "<article><p>cut off <b>he")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("kind", F.lit("k"))
    found = extract(df)
    assert found.columns == ["page_id", "url", "html", "kind", "text", "n_chars"]
    got = {r["page_id"]: r["text"] for r in found.collect()}
    assert got[1] == got[2] == got[5] == ""
    assert got[3] == " ".join(["word and word"] * 50_000)
    assert got[None] == "plain words in a row" and got[4] == "no markup at all" and got[6] == "cut off he"
    assert found.count() == len(rows) and found.where("n_chars <> length(text)").count() == 0
    assert extract(df.limit(0)).count() == 0


def test_a_long_part_to_leave_out_cuts_no_side_of_an_article_off():
    lead, tail, many = "Four word title here", "A last line.", "buy this now " * 30
    parts = [f'<div class="ad">{many}</div>', f"<aside><ul>{'<li><a href=/x>Another story</a></li>' * 60}</ul></aside>", f'<div class="newsletter"><form><p>{many}</p></form></div>']
    for part in parts:
        for outer in ("article", "main"):
            page = lambda a, b: f"<body><{outer}><h1>{a}</h1>{part}<p>{b}</p></{outer}><footer>End</footer></body>"  # noqa: B023, E731
            for a, b in ((lead, "long text " * 200), ("long text " * 200, tail)):
                assert main_text(page(a, b), MODEL) == " ".join(f"{a} {b}".split())
    # outside an article the penalty stays
    assert main_text(f"<p>Short lead.</p>{parts[0]}<p>{'long text ' * 50}</p>", MODEL) == " ".join(["long text"] * 50)


def test_wrappers_named_after_what_stands_beside_the_text():
    article, text = "<article><h1>Title</h1><p>Some words of text.</p></article>", "Title Some words of text."
    for name in ("page has-sidebar", "page sidebar-right", "ad-free", "comments-enabled", "no-ads", "content-sidebar-wrap", "sticky-header", "cookie-layout", "elementor-widget"):
        for wrapped in (article, article.replace("article", "main"), article.replace("<article", '<div role="main"').replace("/article", "/div")):
            assert main_text(f'<body><div class="{name}">{wrapped}</div></body>', MODEL) == text, name
        assert main_text(f'<div id="{name}"><h1>Above</h1>{article}<div class="sidebar">Beside it</div></div>', MODEL) == "Above " + text, name
        assert main_text(f'<div class="{name}"><div class="menu-wrap">{article}</div><aside><article>Other text here</article></aside></div>', MODEL) == text, name
    for name in ("post with-sidebar", "post sidebar-right", "has-comments"):
        assert main_text(article.replace("<article", f'<article class="{name}"'), MODEL) == text
    assert main_text(f'<main class="ads comments sidebar">{article}</main>', MODEL) == text
    # what is no main text stays out
    for out in ('<div class="comments">{}</div>', '<div class="ad">{}</div>', '<div class="related">{}</div>', "<aside><div>{}</div></aside>", '<div role="complementary">{}</div>', '<div hidden class="sidebar">{}</div>',
                '<div class="page sidebar-right"><div class="comments">{}</div></div>', '<div class="sidebar"><nav>{}</nav></div>'):
        assert main_text(out.format(article), MODEL) == "", out
    assert main_text(article + '<div class="sidebar"><article>Read this too</article></div>', MODEL) == text
    assert main_text(f'<div class="page sidebar-right">{article}<div class="sidebar"><article>Read this too</article></div></div>', MODEL) == text
    assert main_text(article.replace("<article", '<article class="comment"'), MODEL) == main_text(article.replace("<article", '<article class="teaser"'), MODEL) == ""


def test_head_without_an_end_tag():
    head = '<html><head><title>x y z</title><meta name="a"><script>var s = "<p>no text";</script><style>p{}</style><!-- c --> '
    for rest in ("<body><p>text and more", "<p>text and more", "text and more", "</head><body><p>text and more", "</head><p>text and more</p>", "<body class=has-sidebar><article>text and more</article>"):
        assert main_text(head + rest, MODEL) == "text and more", rest
    assert main_text("<html><head><title>x</title><body><p>text", MODEL) == "text"
    assert main_text("<head><title>x</title></head>", MODEL) == ""
