import pytest

from statlens.llm import html_text, queries
from statlens.llm.html_text import main_text

LONG = "This is a long paragraph, with commas, and enough words, so that it scores as text would. "


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("plain &lt;text&gt; &amp; more", "plain <text> & more"), ("<p>one<p>two", "one\ntwo"), ("<p>a\n  b<br>c</p>", "a b c"), ("<p>cut off <b>here</b> <a href=", "cut off here"),
    ("<nav><a href=x>menu</a></nav><p>text</p>", "text"), ("<script>var t = '</p>';</script><p>x</p><style>p{}</style>", "x"), ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<title>no</title><article><h1>Head</h1><p>Body.</p></article><footer>f</footer>", "Head\nBody."),
    ("<article><p>Short.</p></article><div class='ad'>" + LONG * 3 + "</div>", "Short."), ("<article><p>A, b.</p><div id=comments><p>" + LONG + "</p></div></article>", "A, b."),
    ("<div class=content><p>" + LONG + "</p><ul><li>item</li></ul></div><div class=sidebar><p>" + LONG * 2 + "</p></div>", LONG.strip() + "\nitem"), ("<form><p>" + LONG + "</p></form><p>t</p>", "t"), ("<p>x</i></div>y</p>", "x\ny"),
    ("<div hidden><p>" + LONG + "</p></div><p>t</p>", "t"), ("<ul><li>" + "<a href=x>link link link</a>" * 20 + "</li></ul><div><p>" + LONG + "</p></div>", LONG.strip()),
])
def test_pages(page, want):
    assert main_text(page) == want


def test_siblings_of_the_best_container_are_kept():
    page = f"<body><div><p>{LONG * 3}</p><p>{LONG * 2}</p></div><p>{LONG}</p><div><p>{LONG * 2}</p></div><div class=share>x</div></body>"
    assert main_text(page).count("\n") == 3


def test_deep_and_broken_pages_end():
    assert main_text("<div>" * 30_000 + "x") == "x"
    assert main_text("<b>" * 5_000 + "</i>" * 5_000 + "x<p " * 2_000 + "<a href=\"" * 2_000).startswith("x")


def test_all_pages_against_their_articles(spark, small):
    """The made pages hold their text in one article: its blocks, by splitting at tags."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op7_html_main_text(spark, small).collect():
        inside = pages[r["page_id"]].split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b.replace("<b>", ""))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", 1), (1, "u", "<p>x</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, n_chars long")
    assert sorted(str(tuple(r)) for r in html_text.extract(df).collect()) == ["(1, 'u', 'x', 1)", "(1, 'u', 'x', 1)", "(None, None, '', 0)"]
    assert html_text.extract(df.limit(0)).count() == 0
