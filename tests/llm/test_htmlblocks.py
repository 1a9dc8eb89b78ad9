import html as entities
import random
import re
import time

import pytest

from sparkloom.llm.htmlblocks import SURGE, WINDOW, extract, extract_table, main_text, stretches

LONG = ("long words of an article " * 6).strip()


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Menu</a></nav>", ""),
        ("<article><h1>T</h1><p>a  b\n c<br>d</p>tail</article><footer>f</footer>", "T\na b c d\ntail"),
        ("<article><p>x &amp; &eacute; &#233; &lt;b&gt;</p></article>", "x & é é <b>"),
        ('<article><script>var t="</p><p>no";</script><style>p{}</style><p>yes</p><!-- <p>no</p> --></article>', "yes"),
        ("<article><p><b>one<br><p>two</article>", "one\ntwo"),
        ("<article><p>in<b>lin</b>e</p><aside>side</aside><form><p>field</p></form><div class='ad'>buy</div></article>", "inline"),
        ("<article><p>t</p><section id=comments><p>reader says " + "so " * 90 + "</p></section></article>", "t"),
        ("<main><header><h2>Head</h2><p>by me</p></header><p>1 < 2 and 3 > 2</p></main>", "Head\n1 < 2 and 3 > 2"),
        ("<body><div class=menu>Home</div><h2>Title</h2><p>" + "word " * 40 + "</p><p>short</p><p>" + "more " * 40 + "</p><div class='cookie-notice'>" + "ok " * 50 + "</div></body>", "Title\n" + ("word " * 40).strip() + "\nshort\n" + ("more " * 40).strip()),
        ("<p>loose", "loose"),
        ("<article><div hidden><p>no</p></div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc d"),
        (f"<article><p>{LONG}</p><section id=comments><article class=comment><p>{LONG}</p></article><article><p>x</p></article></section><p>end</p></article>", LONG + "\nend"),
        (f"<main><p>{LONG}</p></main><ol class='comment-list'><li><article class='comment-body'><p>{LONG}</p></article></ol>", LONG),
        (f"<aside><article><p>{LONG} teaser</p></article></aside><article><p>{LONG}</p></article>", LONG),
        (f"<div class='content no-sidebar'><p>{LONG}</p><div class='tags side share'>kept</div><math><mi>x</mi></math><noscript>y</noscript></div>", LONG + "\nkept\nx y".replace(" ", "")),
        (f"<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><h1>Head</h1><p>by me<p>{LONG}<p>a<p>b<p>c<p>the end<ul><li><a href=c>1</a><li><a href=d>2</a><li><a href=e>3</a></ul><p>(c) me", f"Head\nby me\n{LONG}\na\nb\nc\nthe end"),
        (f"<div>{LONG}</div><p><a href=x>{LONG}</a><p><a href=y>{LONG}</a><p><a href=z>{LONG}</a><div>far</div>", LONG),
        (f"<div class=ad>never closed <article><p>{LONG}</article>", LONG),
        ('<article><p title="a > b">x</p><p title=\'>y</p><p>"z"</p></article>', 'x\ny\n"z"'),
        ("<article><p>unclosed <div class=ad><p>never closed</article><p>after", "unclosed"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("seed", range(30))
def test_stretches_are_those_of_the_window_sums(seed):
    g = random.Random(seed)
    weights = [g.choice([0, 0, 0, 3, 50, 400]) for _ in range(g.randint(0, 60))]
    at = lambda i: weights[i] if 0 <= i < len(weights) else 0
    want, run = [], []
    for i in range(len(weights) + WINDOW):
        window = [at(j) for j in range(i - WINDOW + 1, i + 1)]
        if sum(window):
            run.append(i)
        elif run:
            own = [j for j in range(run[0], run[-1] + 1) if at(j)]
            want.append((own[0], own[-1], max(sum(at(j) for j in range(k - WINDOW + 1, k + 1)) for k in run)))
            run = []
    assert stretches(weights) == want


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a \"'", "</script ", "<svg>", "<div class=ad>", "<", "<!--", "<a '\"x> ", "<b>", "</p>"])
def test_broken_pages_take_time_in_proportion(piece):
    main_text("warm")
    page = piece * (300_000 // len(piece))
    for p in (page, page + ">", page + "'>" + LONG):
        began = time.thread_time()
        main_text(p)
        assert time.thread_time() - began < 4


def test_windows_decide_without_an_article(spark):
    """The given pages with a plain division in place of the article: menus are
    links, the advert and the footer are short or named."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert SURGE and pages
    for r in pages:
        plain = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(plain) == main_text(r.html)


def test_query_against_brute_force(spark):
    """The test pages hold one article each, whose blocks are h1 and p."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inside)
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks]
        want[r.page_id] = "\n".join(x for x in lines if x)
    got = extract_table(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "m"), (2, "u", "<p>" + "x " * 10**6, "m"), (2, "u", "", "m")], "page_id long, url string, html string, main string")
    assert sorted(r.n_chars for r in extract_table(rows).collect()) == [0, 0, 2 * 10**6 - 1]
    assert extract_table(rows.limit(0)).count() == 0 and {"main", "_main"} <= set(extract(rows).columns)
    assert {r.main for r in extract(rows).collect()} == {"m"}
