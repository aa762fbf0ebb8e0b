"""Main texts of pages whose article is known, over templates and hosts."""
from __future__ import annotations

import html
import random

import pytest

from licmatch.llm.host_paths import Page, extract_pages, host_of

TEMPLATES = {
    "semantic": "<html><body><nav><ul>{menu}</ul></nav><main><article>{text}</article>{notes}"
                "</main><aside>{side}</aside><footer>{foot}</footer></body></html>",
    "named": "<body><div id='top-menu'>{menu}</div><div class='entry-content p{n}'>{text}</div>"
             "<div class='sidebar'>{side}</div>{notes}<div id=footer>{foot}",
    "plain": "<body><div><ul>{menu}</ul></div><div class='q{n}'>{text}</div>"
             "<div class='r'><p>{foot}</p></div></body>",
    "table": "<table><tr><td><ul>{menu}</ul></td><td class=x>{text}</td></tr></table>{notes}",
    "nested": "<div class=wrap><div class=inner><header>{foot}</header>"
              "<div class='post'><header>{head}<span class=byline>By A</span></header>{rest}"
              "<form><input value=1>Send <button>ok</button></form></div></div>{notes}</div>",
}
NOTES = ("<div id='comments'><h2>2 comments</h2><div class='comment'><p>A very long remark of a "
         "reader that says much about nothing at all, twice over.</p></div></div>"
         "<div class='cookie-notice'>We use cookies.</div><div class='ad'>Buy this</div>")


def page(template, n, prose):
    r = random.Random(n)
    blocks = [prose(1000 * n + k, r.randint(3, 60)) + " a < b & c" for k in range(r.randint(2, 6))]
    title = prose(n, 5)
    marked = [f"<p>{html.escape(b)}</p>" if r.random() < 0.7 else f"<p>\n{html.escape(b)} "
              for b in blocks]
    marked[0] = marked[0].replace(" ", " <b>", 1).replace(" a ", "</b> a ")
    rest = "<script>var x = '</p><p>no';</script><!-- <p>no</p> -->".join(marked)
    markup = TEMPLATES[template].format(
        n=n, text=f"<h1>{title}</h1>{rest}", head=f"<h1>{title}</h1>", rest=rest,
        menu="".join(f"<li><a href='/{k}'>Menu {k}" for k in range(6)), notes=NOTES,
        side="Read <a href=x>more</a>", foot="&copy; The host of all these pages")
    return markup, "\n".join([title, *blocks])


@pytest.mark.parametrize("template", sorted(TEMPLATES))
def test_articles_of_a_host(spark, prose, template):
    made = [page(template, n, prose) for n in range(12)]
    rows = [(n, f"https://u@{template}.Example.com:80/{n}", m) for n, (m, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in extract_pages(df).collect()}
    for n, (_, text) in enumerate(made):
        assert got[n].text == text, n
        assert got[n].n_chars == len(text) and got[n].url == rows[n][1]


def test_consensus_beats_a_page_of_its_own_mind(spark, prose):
    """A short article below a long unnamed box is found by what the host's other pages say."""
    rows = []
    for n in range(10):
        words = 120 if n else 25
        rows.append((n, "http://h.example/x", f"<body><div class=t><p>{prose(n, words)}</p></div>"
                        f"<div class=u><p>{prose(50 + n, 5 if n else 60)}</p></div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert got == {n: prose(n, 120 if n else 25) for n in range(10)}


def test_repeated_box_inside_the_article_goes(spark, prose):
    rows = [(n, "http://h.example/x", f"<article><p>{prose(n, 60)}</p><div class=z><p>The same "
                f"words on all pages.</p></div><ul class=y><li><a href=1>A{n}</a><li>"
                f"<a href=2>B{n}</a></ul></article>") for n in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert got == {n: prose(n, 60) for n in range(5)}


def test_copies_of_one_page_keep_their_text(spark, prose):
    rows = [(1, "http://h.example/x", f"<article><p>{prose(1, 60)}</p><div><p>tail</p></div>"
                "</article>")] * 7
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.text for r in extract_pages(df).collect()] == [prose(1, 60) + "\ntail"] * 7


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "", "only text"), (4, "http://a", "<p>a<p>b"),
            (5, "//a/b", "<div>" * 20_000 + "deep" + "</div>" * 20_000),
            (6, "http://a", "<article>a &#x41;&#66; &am <foot"), (7, "http://a", "<script>x <p>y"),
            (8, "http://a", "<!-- never <p>closed"), (9, "http://a", "<p>x < y and 3<4</p>"),
            (10, "http://a", "<p title=it's>q</p></div></p></b>"), (11, "http://a", "a\x00b"),
            (12, "http://a", "<p>one&nbsp;two<br>three\n four</p>" + "<p>w</p>" * 30_000)]
    df = spark.createDataFrame([(*row, 1, "c") for row in rows],
                               "page_id int, url string, html string, voted int, host string")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert got == {1: "", 2: "", None: "only text", 4: "a\nb", 5: "deep", 6: "a AB &am", 7: "",
                   8: "", 9: "x < y and 3<4", 10: "q", 11: "a\x00b",
                   12: "one two three four" + "\nw" * 30_000}
    assert extract_pages(df.limit(0)).count() == 0


def test_hosts(spark):
    rows = [("HTTP://Me:pw@Some.Host:8080/a?b#c", "some.host"), ("//x.y", "x.y"), ("no host", None),
            (None, None), ("https://é.example/", "é.example"), ("mailto:a@b", None)]
    df = spark.createDataFrame(rows, "url string, want string")
    assert all(r.host == r.want for r in df.select(host_of().alias("host"), "want").collect())


def test_wrappers_and_headers():
    assert Page("<div class='content-sidebar-wrap'><main class=content><h1>T</h1><p>Real text"
                "</main><div class=sidebar>no</div></div>").text([], []) == "T\nReal text"
    assert Page("<article><header><h1>T</h1><p>By X</p></header><p>Text</article>"
                "<article class=comment><p>bad</article>").text([], []) == "T\nText"
