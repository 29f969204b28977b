import html as H
import re

from casestory.llm import html_extract as op
from casestory.llm import queries

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page-12 has-sidebar">
<header class="site-header"><h2>Site name</h2><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav></header>
<div id="cookie-notice"><p>We use cookies, accept them please, all of them, now.</p></div>
<!-- a comment with <p>markup</p> > -->
<div class="content post-%d"><h1>Head &amp; line</h1>
<p>First   paragraph with <b>bold&nbsp;text</b>, commas, and <a href="/x">a link</a>, long enough to count for the score.
<p title="a > b">Second paragraph, unclosed, with an entity &eacute;&#x41; and a break<br>inside, also long enough to count here.
<div class="ad"><p>Buy this now, it is an advert, long enough to count as a paragraph, really.</p></div>
<ul><li>one item of the list<li>two</ul>
<blockquote>Quoted words</blockquote>
<form><p>Your mail</p><input name=q><button>Send</button></form>
<script>if (a < b) { document.write("<p>no</p>") }</script>
</div>
<aside><p>Sidebar text that is long enough, with commas, to look like an article, nearly.</p></aside>
<section class="comments"><div class="comment"><p>Reader comment, which is long, very long, and has many, many commas, as comments do, to win if it could.</p></div></section>
<footer>&copy; 2020 Site</footer></body></html>"""
WANT = "\n\n".join(["Head & line", "First paragraph with bold text, commas, and a link, long enough to count for the score.",
                    "Second paragraph, unclosed, with an entity éA and a break inside, also long enough to count here.",
                    "one item of the list", "two", "Quoted words"])


def test_asides_markup_and_references():
    assert op.main_text(op.analysed(ARTICLE % 7), None) == WANT


def test_head_without_end_tag():
    """An open head ends at the body, at what cannot stand in a head, and at text."""
    article = ARTICLE % 7
    want = op.analysed(article)
    for html in (article.replace("</head>", ""), article.replace("</head>", "\n<meta charset=utf-8><link rel=x href=y>\n"),
                 article.replace("</head>", "<noscript><img src=z>unseen</noscript>"), article.replace("</head>", "<noscript><style>p{}</style>")):
        page = op.analysed(html)
        assert op.main_text(page, None) == WANT and op.votes(page).keys() == op.votes(want).keys()
    text = lambda h: op.main_text(op.analysed(h), None)
    assert text("<head><title>T</title><p>one<p>two") == "one\n\ntwo" and text("<head><meta name=a> words <b>here</b>") == "words here"
    assert text("<html><head><title>T</title><style>s</style><script>x</script>") == text("<head>\n<title>T</title>\n") == ""


def test_awkward_pages():
    text = lambda h: op.main_text(op.analysed(h), None)
    assert text(None) == text("") == text("<html></html>") == text("<script>x") == text("<!-- open") == ""
    assert text("just words & more") == "just words & more"
    assert text("<p>a<p>b") == "a\n\nb" and text("a < b and </ c") == "a < b and </ c"
    assert text("<div>" * 30_000 + "deep" + "</div>" * 10) == "deep"
    assert text("<p>" + "word " * 200_000).count("word") == 200_000
    assert text("<article><p>kept</p></article><p title='unclosed") == "kept"
    assert text("<main><p>one</main></p></b><p>two") in ("one", "one\n\ntwo")


def test_consensus_overrules_an_odd_page(spark):
    """A page on which a teaser outscores the article follows its host."""
    usual = "<body><div class='teasers'><p>{t}</p></div><div class='story s{k}'><h1>H{k}</h1><p>{p}</p></div></body>"
    words = "an article sentence, with a comma, and enough words to be counted as text. "
    rows = [(k, "https://User@News.example.org:8/x/%d?y" % k, usual.format(k=k, t="short teaser", p=words * 5)) for k in range(8)]
    odd = usual.format(k=99, t="teaser, teaser, " * 60, p=words)
    rows += [(99, "//news.example.org/odd", odd), (100, "http://alone.example.org", odd), (None, None, None), (101, None, "<p>x</p>"), (99, "//news.example.org/odd", odd)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as host", "1 as path", "2 as n", "'t' as text")
    got = op.extract(df).collect()
    assert len(got) == len(rows)
    text = {r["id"]: r["text"] for r in got}
    assert text[99] == "H99\n\n" + words.strip() and text[100].startswith("teaser") and text[None] == "" and text[101] == "x"
    assert all(text[k] == f"H{k}\n\n" + (words * 5).strip() for k in range(8))
    assert op.extract(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in queries.op5_html_extract(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search("<article>(.*)</article>", p["html"], re.S)[1]
        blocks = (" ".join(H.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1|ul|li|div)[^>]*>", body))
        want = "\n\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want) and got[p["page_id"]]["url"] == p["url"]
