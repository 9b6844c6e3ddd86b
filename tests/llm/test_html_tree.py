import itertools
import math
import random
import re
from html import unescape

import numpy as np
import pytest

from spotrates.llm import html_tree as H
from spotrates.llm.common import table


def article(source):
    """The article of a page of the test tables, by its markup alone."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", " " if False else "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table_equals_its_articles(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in H.op5_tree_model_html(spark, sf).collect()}
    rows = table(spark, sf, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_sum_product_equals_enumeration():
    rng = random.Random(0)
    parent = [-1, 0, 0, 1, 1, 2, 3]
    local = [rng.gauss(0, 1) for _ in parent]
    links = np.array([[rng.gauss(0, 1) for _ in (0, 1)] for _ in (0, 1)])
    total, marginal, pairs = 0.0, [0.0] * 7, np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=7):
        w = math.exp(sum(a * b for a, b in zip(local, y)) + sum(links[y[parent[i]], y[i]] for i in range(1, 7)))
        total += w
        for i in range(7):
            marginal[i] += w * y[i]
        for i in range(1, 7):
            pairs[y[parent[i]], y[i]] += w
    got_pairs = [[0.0, 0.0], [0.0, 0.0]]
    assert H.sum_product(parent, local, links, got_pairs) == pytest.approx([m / total for m in marginal])
    assert np.array(got_pairs) == pytest.approx(pairs / total)


@pytest.fixture(scope="module")
def model(spark):
    return H.learn(table(spark, "/root/testdata/sf0.01", "pages"))


P1 = "Anha the of are haedre anti the a theaatnd or it ing thshst the thsh, and more words follow here."
P2 = "Ndstst onnt rehe <a href='/x'>ononenen</a> atenan &eacute;t&#233; &amp;\n\n   this, edblees&nbsp;onor inwh atble."
Q1, Q2 = P1, "Ndstst onnt rehe ononenen atenan été & this, edblees onor inwh atble."


@pytest.mark.parametrize("around", [
    "<body><nav><ul><li><a href=/>Home</a></ul></nav><article>{}</article><footer>(c) all rights</footer>",
    "<body><header><a href=/>Site</a> Our motto is long enough.</header><main>{}</main><aside><p>Other stories that you may read, "
    "they are long too.</p></aside>",
    "<body><div class='cookie-notice'><p>We use cookies, please accept them all, thank you very much.</p></div>"
    "<div id=content>{}</div><section class=comments><h3>Comments</h3><p>I do not agree with any of this at all, sorry.</p></section>",
    "<body><article>{}<div class='userComments'><p>First! This is what readers say about it, at some length.</p></div></article>"
    "<form><p>Subscribe to the letter, it is sent to you every week.</p><input><button>Go</button></form>",
    "<body><article>{}<div class='ad'>Buy this thing now, it is cheap and good.</div></article><script>var x='<p>no</p>'</script>",
])
def test_other_layouts(model, around):
    page = around.format(f"<h1>A heading</h1><p>{P1}<p>{P2}<br><style>p{{}}</style>")
    assert H.extract(page, *model) == f"A heading\n{Q1}\n{Q2}"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<main><p><article>{}</article></main>"])
@pytest.mark.parametrize("block, text", [
    ("<ul><li>one</li><li>two</li></ul>", "one\ntwo"),
    ("<ul><li><a href=/x>one</a></li><li><a href=/y>two</a></li></ul>", "one\ntwo"),
    ("<table><tr><td>1</td><td>2</td></tr></table>", "1\n2"), ("<p>Note</p>", "Note"), ("<pre>x = 1</pre>", "x = 1"),
    ("<p><a href=/x>All of this is one link</a></p>", "All of this is one link"),
    ("<section class='related-work'><h2>Others</h2><p>They did it.</p></section>", "Others\nThey did it."),
    ("<div class='legal'>Text of the law</div>", "Text of the law"),
    ("<fieldset><legend>A box</legend>of text</fieldset>", "A box\nof text"),
    ("<div class='related-posts'><ul><li><a href=/x>one</a></li><li><a href=/y>two other</a></li></ul></div>", ""),
    ("<div class='tags'><a href=/x>one</a> <a href=/y>two</a></div>", ""), ("<div class='share'><a href=/x>Send</a></div>", ""),
    ("<aside><p>A side story with many words in it.</p></aside>", ""), ("<div class=notice>We use data.</div>", ""),
    ("<form><label>Name</label><fieldset><legend>x</legend><input></fieldset></form>", "")])
def test_blocks_of_an_article(model, around, block, text):
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav>" + around.format(
        f"<h1>A heading</h1><p>{P1}</p>{block}<p>{P2}</p>") + "<footer>(c) x</footer>"
    assert H.extract(page, *model) == "\n".join(x for x in ("A heading", Q1, text, Q2) if x)


def test_article_without_paragraphs(model):
    page = "<body><article><h1>A heading</h1><div class='legal'>Text of the law</div><fieldset>some fields</fieldset></article>"
    assert H.extract(page, *model) == "A heading\nText of the law\nsome fields"


@pytest.mark.parametrize("around", ["<div id=content>{}</div>", "<div class=post>{}</div>", "<div>{}</div>"])
def test_lists_on_pages_without_an_article(model, around):
    page = "<body><div class=nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>" + around.format(
        f"<h1>A heading</h1><p>{P1}</p><ul><li>one</li><li>two</li></ul><p>{P2}</p>") + "<div class=footer>(c) x</div>"
    assert H.extract(page, *model) == f"A heading\n{Q1}\none\ntwo\n{Q2}"


def test_edge_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<"), (3, "u", "<article><p>" + "word " * 200_000 + "</p></article>"),
            (4, "u", "<div>" * 3000 + "x"), (5, "u", "<!-- open"), (6, "u", "<script>never closed"), (1, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text")
    got = {r.page_id: r for r in H.main_text(df, model).collect()}
    assert got[1].text == got[2].text == got[5].text == got[6].text == "" and got[3].n_chars == 200_000 * 5 - 1
    assert H.main_text(df.limit(0), model).collect() == []
    assert H.learn(df.limit(0))[0] == pytest.approx(H.PRIOR)


@pytest.mark.parametrize("tag", [
    "<svg class='i'/>", "<svg viewBox='0 0 1 1' />", "<video-player src=x></video-player>", "<svg-icon name=a></svg-icon>",
    "<math/>", "<iframe src='x'/>", "<video src=x>", "<object data=x>", "<svg><text>no</text></svg>", "<script src=/x/></script>",
    "<svg class=i/><title>no</title></svg>"])
@pytest.mark.parametrize("later", ["", "<footer><svg><path d='M0'></path></svg><video src=y></video></footer>"])
def test_embedded_elements_leave_the_rest(model, tag, later):
    if later and tag in ("<video src=x>", "<object data=x>"):
        later = ""
    page = f"<body><article><h1>A heading</h1><p>{P1}</p>{tag}<p>{P2}</p></article>{later}"
    assert H.extract(page, *model) == f"A heading\n{Q1}\n{Q2}"


def test_formulas_keep_their_text(model):
    formula = "<math><mi>x</mi> <mo>=</mo> <mn>2</mn><annotation encoding='application/x-tex'>x=2</annotation></math>"
    page = f"<body><article><h1>A heading</h1><p>{P1} {formula}</p><p>{P2}</p></article>"
    assert H.extract(page, *model) == f"A heading\n{Q1} x = 2\n{Q2}"


def test_unclosed_raw_text_reaches_the_end(model):
    for tag in ("script", "style", "textarea"):
        assert H.extract(f"<body><article><p>{P1}</p><{tag}>var x; <p>{P2}</p></article>", *model) == Q1


@pytest.mark.parametrize("head", [
    "<html><head><title>T</title><body>", "<html><head><meta charset=utf-8><title>T</title><script>x</script>",
    "<head><title>T<body>", "<html><head><title>T</head><body>", "<title>T</title>", "<html><head><title>A <p> tag</title><body>",
    "<html><head><title>T</title><link rel=x></head><body>"])
def test_head_ends_where_the_body_starts(model, head):
    page = f"{head}<article><h1>A heading</h1><p>{P1}</p><p>{P2}</p></article>"
    assert H.extract(page, *model) == f"A heading\n{Q1}\n{Q2}"
