"""Main text of hand-made pages, with potentials learnt from the table's pages and with priors alone."""

import html as entities
import re

import pytest

from spectraline.llm import html
from spectraline.llm import queries as Q

SF = "/root/testdata/sf0.001"
L = "A rather long sentence of the article that goes on for a while, so that it fills a line or two."
PAGES = {
    f"<html><head><title>t</title><body><article><h1>Head</h1><p>{L}</article>": f"Head {L}",
    f"<body><article><p>{L}<select><option>a<p>more text here</p></article><footer>f</footer>": f"{L} more text here",
    f"<body><form><select><option>a</form><article><p>{L}</article>": L,
    f"<body><article><p>{L}</p><svg><path d='x'><p>after it</p></article>": f"{L} after it",
    f"<body><article><p>{L}<svg><text>no</text></svg> rest</p></article>": f"{L} rest",
    f"<body><object><param><article><p>{L}</p></article>": L,
    f"<title>no end<body><article><p>{L}</p></article>": L,
    f"<article><div class='article-header'><h1>Head line</h1></div><p>{L}</p></article>": f"Head line {L}",
    f"<header><p>Site name here</p></header><article><header><h1>Head line</h1></header><p>{L}</p></article>": f"Head line {L}",
    f"<article><p>{L}</p><p class='share-price'>The price of a share went up.</p><div class='share-buttons'><a href=x>Send</a></div></article>": f"{L} The price of a share went up.",
    f"<article><p class=o'brien>Short text.</p><p>{L}</p></article>": f"Short text. {L}",
    f'<article><p title="a > b">Text here</p><p>{L}</p></article>': f"Text here {L}",
    f"<article><p>{L}</p><section id=comments>{'<p>' + L + ' no</p>'}</section></article>": L,
    f"<article><p>{L}</p><div class='comment-list'>{('<p>' + L + ' no</p>') * 9}</div></article>": L,
    f"<body class='has-sidebar'><div class='banner-wrap'><main><p>{L}</p><p>Yes.</p><form><p>{L} no</p></form></main></div><aside><article><p>{L} no</p></article></aside>": f"{L} Yes.",
    f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>{L}</p><p>{L}</p></div></body>": f"{L} {L}",
    f"<div class='cookie-notice'><p>{L} no</p></div><article><p>{L}</p></article>": L,
    f"<article><p>{L}</p><noscript><p>no</p></noscript><template><p>no</p></template><p>Fine end.</p></article>": f"{L} Fine end.",
    f"<article><p>{L}</p><script>var a='</p>';no()</script ><!-- no --><p>End of it.</p></article>": f"{L} End of it.",
    "<article><h1>x</h1><ul><li>first item</li><li>second</li></ul><p>Short.</p></article>": "x first item second Short.",
    "<body><nav><a href=x>Home</a></nav><article><h1>Head &amp; all</h1><p>Some  text<br>of it.</article><div class='comments'><p>I disagree.</div><footer>x</footer>": "Head & all Some text of it.",
    "plain": "plain",
    f"<body><div class='post about-login'><p>{L}</p><p>{L}</p></div>": f"{L} {L}",
    f"<body><div class='recipe cookies'><h2>Cookies</h2><p>{L}</p><p>{L}</p></div><div class='cookies'><p>{L} no</p></div>": f"Cookies {L} {L}",
    f"<body><div id='related-research'><p>{L}</p><p>{L}</p></div><div id=related><a href=x>Other things</a></div>": f"{L} {L}",
    f"<body><div class='layout sidebar-right'><div class=content><p>{L}</p><p>{L}</p></div><div class=sidebar><p>{L} no</p></div></div>": f"{L} {L}",
    f"<body class=x><div class='page two-column-sidebar'><p>{L}</p><p>{L}</p></div><footer>{L} no</footer>": f"{L} {L}",
    f"<body><form id=aspnetForm><nav>no</nav><div><p>{L}</p><p>{L}</p></div><fieldset><label>no</label></fieldset></form>": f"{L} {L}",
    f"<body><div class=modal><p>{L}</p><p>{L}</p></div>": f"{L} {L}",
    f"<!--><article><p>{L}</p><!---><p>Then more of it.</p><!-- no --!><p>And the end.</p></article>": f"{L} Then more of it. And the end.",
    f"<body><div class=post><p>{L}</p></div><div class='comments-area'>{('<div class=comment><p>' + L + ' no</p></div>') * 30}</div>": L,
    f"<body><div class=story><p>{L}</p><p>{L}</p></div><form class=search-form><p>{L} no</p></form><div class='newsletter-signup'><p>{L} no</p></div>": f"{L} {L}",
}


@pytest.fixture(scope="module")
def learnt(spark):
    return html.trained(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("page", PAGES)
def test_hand_made_page(learnt, page):
    assert learnt.text(page) == PAGES[page] and html.Model({}).text(page) == PAGES[page]


def test_blocks_of_labelled_pages(spark):
    """The text between <article> and </article>, by plain string work, on every page of the table."""
    out = {r.page_id: r for r in Q.op9_html(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.sub(r"</?(?:p|br|h1)>", "\n", r.html.split("<article>")[1].split("</article>")[0])
        text = " ".join(entities.unescape(re.sub(r"<[^>]+>", "", inner)).split())
        assert (out[r.page_id].text, out[r.page_id].n_chars) == (text, len(text))


def test_counts_outweigh_priors():
    page = f"<body><div class='story-tags'><p>{L}</p></div><article><p>{L}</p></article>"
    some, many = (html.Model({k: n * v for k, v in html.counts(page).items()}) for n in (1, 1000))
    assert some.weight == many.weight and some.weight != html.Model({}).weight
    more = html.counts("<article>" + "<h2>Short</h2>" * 5 + "</article>")
    assert html.Model(dict(more)).weight["tag:h2"] > html.Model({}).weight["tag:h2"]


def test_messages_are_exact():
    """Marginals of a small tree against the sum over all its labellings."""
    import itertools
    import math

    model, tree = html.Model({}), html.Tree(f"<div class=content><p>{L}</p>short</div><div class=search><p>{L}</p></div>")
    n, total = len(tree.parent), None
    total = [[0.0, 0.0] for _ in range(n)]
    for y in itertools.product((0, 1), repeat=n):
        score = sum(y[i] * (sum(model.weight[f] for f in tree.seen[i]) + html.ROOT_ODDS * tree.top[i]) for i in range(n))
        for i in range(1, n):
            score += math.log(model.edge[tree.kind(i)][2 * y[tree.parent[i]] + y[i]])
        for i in range(n):
            total[i][y[i]] += math.exp(score)
    assert model.marginals(tree) == pytest.approx([math.log(b / a) for a, b in total])


def test_odd_rows(spark, learnt):
    schema = "page_id long, url string, html string, text string, n_chars string"
    long = f"<article>{'<p>' + L + '</p>'}" * 3000
    rows = [(1, "u", None, "x", "y"), (2, None, "", "x", "y"), (None, "u", "plain", None, None), (4, "u", long, None, None), (4, "u", long, None, None)]
    out = html.main_text(spark.createDataFrame(rows, schema), learnt).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == [("1", 0), ("2", 0), ("4", 3000 * (len(L) + 1) - 1)] + [("4", 3000 * (len(L) + 1) - 1), ("None", 5)]
    none = spark.createDataFrame([], schema)
    assert html.main_text(none, html.trained(none)).count() == 0
