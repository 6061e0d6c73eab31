"""Main texts against pages whose text is known."""

from tamis.llm import html_templates, markup

SHELL = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad 1 --><div class="ad-box">Buy {t}</div>
<div id="cookie-notice">We use cookies</div>{body}<aside>Side {t}</aside><section class="comments"><article><p>Nice {t}!</p></article></section>
<form>Search <input></form><footer>&copy; host {t}</footer></body></html>"""


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string, token string, text string")
    return [(r["key"], r["text"]) for r in html_templates.main_texts(df).collect()]


def page(i, body, host="h.example"):
    return (i, f"http://{host}/{i}", body, "x", "x", "x")


def test_articles(spark):
    pages = [page(i, SHELL.format(t=f"t{i}", body=f"<article><h1>Head {i}</h1><p><b>Bo</b>dy{i} &amp; more&nbsp;&lt;x&gt;<br>line\n\n two<p>Next {i}</p></article>")) for i in range(8)]
    got = dict(texts(spark, pages))
    assert got == {i: f"Head {i} Body{i} & more <x> line two Next {i}" for i in range(8)}


def test_pages_without_articles(spark):
    """Only the template tells the label and the menu from the text."""
    body = '<div class="x"><div class="y"><a href="1">One</a> <a href="2">Two {i}</a></div><div class="z"><span>Published by us</span><p>Own text {i} of this page</p></div></div>'
    pages = [page(i, SHELL.format(t=f"t{i}", body=body.format(i=f"n{i}"))) for i in range(6)]
    got = dict(texts(spark, pages))
    assert got == {i: f"Own text n{i} of this page" for i in range(6)}


def test_template_runs_in_articles(spark):
    """No class or tag tells the share line and the note; a repeated run within a paragraph stays."""
    body = "<article><div>Share this page with others</div><p>Own words {i} of a longer text <b>and</b> <i>more</i> {i}</p><div><span>Published by</span> <b>us</b></div></article>"
    pages = [page(i, SHELL.format(t=f"t{i}", body=body.format(i=f"n{i}"))) for i in range(6)]
    assert dict(texts(spark, pages)) == {i: f"Own words n{i} of a longer text and more n{i}" for i in range(6)}
    copies = [page(i, SHELL.format(t=f"t{i}", body=f"<article><p>One long text that all pages have</p><p>Date {i}</p></article>")) for i in range(6)]
    assert dict(texts(spark, copies)) == {i: f"One long text that all pages have Date {i}" for i in range(6)}


def test_class_words_do_not_beat_articles(spark):
    """Tags and categories in an article's class, names that contain a word, headings, titles in headers, formulas."""
    kept = {
        '<article class="post tag-comments category-promotion"><p>Tagged {i}</p></article>': "Tagged {i}",
        '<div id="alert-level"><article><p>Alert {i}</p></article></div>': "Alert {i}",
        '<article><h2 id="related-work">Related work</h2><p>Cited {i}</p></article>': "Related work Cited {i}",
        "<article><header><h1>Title {i}</h1></header><p>Body {i}</p></article>": "Title {i} Body {i}",
        "<main><h1>Top {i}</h1><article><p>Inner {i}</p></article></main>": "Top {i} Inner {i}",
        "<article><p>Sum <math><mi>x{i}</mi></math> holds</p></article>": "Sum x{i} holds",
        '<article><p>Own {i}</p><div class="share-bar">Share</div></article><ol class="comment-list"><li><article><p>Nice</p></article></li></ol>': "Own {i}",
        '<article><p>First {i}</p></article><article class="comment"><p>Reply {i}</p></article>': "First {i}",
        '<article><p>Real {i}</p></article><div class="related-posts"><article><p>Other {i}</p></article></div>': "Real {i}",
    }
    pages = [page(10 * k + i, f"<html><body>{body.format(i=f'n{i}')}</body></html>", f"h{k}.example") for k, body in enumerate(kept) for i in range(5)]
    assert dict(texts(spark, pages)) == {10 * k + i: text.format(i=f"n{i}") for k, text in enumerate(kept.values()) for i in range(5)}


def test_headings_of_all_pages_stay(spark):
    body = "<article><h1>Dish {i}</h1><h2>Ingredients</h2><p>Flour {i} and water {i} with salt</p><h2>Method</h2><p>Knead {i} and bake {i} well</p><p>Print this recipe</p></article>"
    pages = [page(i, SHELL.format(t=f"t{i}", body=body.format(i=f"n{i}"))) for i in range(6)]
    want = "Dish n{i} Ingredients Flour n{i} and water n{i} with salt Method Knead n{i} and bake n{i} well"
    assert dict(texts(spark, pages)) == {i: want.format(i=i) for i in range(6)}


def test_a_host_of_copies(spark):
    pages = [page(i, "<html><body><nav>Menu</nav><div><p>One text</p><p>for all</p></div></body></html>") for i in range(5)]
    assert dict(texts(spark, pages)) == {i: "One text for all" for i in range(5)}


def test_odd_pages(spark):
    cut = SHELL.format(t="t", body="<article><p>Kept to the end")[: SHELL.format(t="t", body="<article><p>Kept to the end").index("to the end") + 10]
    pages = [
        page(1, None), page(2, ""), page(3, "Plain text  only"), page(4, cut), (None, None, "<article>No url</article>", "x", "x", "x"),
        page(5, "<article>Twice</article>"), page(5, "<article>Twice</article>"), page(6, "<article>" + "word " * 50_000 + "</article>"), page(7, "<article>a < b and <b>c</b>d <i"),
    ]
    got = sorted(texts(spark, pages), key=str)
    want = [(1, ""), (2, ""), (3, "Plain text only"), (4, "Kept to the end"), (None, "No url"), (5, "Twice"), (5, "Twice"), (6, ("word " * 50_000).strip()), (7, "a < b and cd")]
    assert got == sorted(want, key=str)


def test_no_pages(spark):
    assert texts(spark, []) == []


def test_markup():
    got = [(e.name, e.text) for e in markup.read("<ul><li>a<li>b</ul><p>c<div>d</div><!-- <p> --><script>x<y</script>e</p>")]
    assert got == [
        ("<ul>", None), ("<li>", None), ("", "a"), ("<li>", None), ("", "b"), ("</ul>", None), ("<p>", None), ("", "c"), ("<div>", None), ("", "d"), ("</div>", None), ("", "e"),
    ]
