import json

from motifline.llm import wrappers as W

PAGE = """<html><head><title>x</title></head><body class="home"><header><h1>Site</h1></header><div id="cookie-banner">We use cookies</div>
<nav><ul><li>menu</ul></nav><main><div class="sidebar">side</div>
<article class="post-12 post"><h1>T&amp;t</h1><p>One <b>two</b> three<span class="ad">AD</span> four&nbsp;five<p>Next<br>line<ul><li>a<li>b</ul>
<table><tr><td>c<td>d</table><div class="share-buttons">share</div><aside>no</aside><form>f<input></form><script>if (a<b) "</p>"</script><!-- c -->
tail < x</article><section class="comments"><article class="comment"><p>hi</p></article></section></main><footer>f</footer>"""
TEXT = "T&t\nOne two three four five\nNext line\na\nb\nc\nd\ntail < x"


def test_wrapper_of_one_page():
    tree = W.page_tree("<body><ul><li>a<li>b<li>c</ul><p>x<b>y</b>")
    assert W.expression(tree) == "<><body><ul><li>#</>+</><p>#</></></>"


def test_mismatches_become_optional_repeated_or_slots():
    two = [W.page_tree(h) for h in ("<div>a<p>b</p></div>", "<div><h2>t</h2><p>b</p><p>c</p><i>z</i></div><hr>")]
    for w in (W.join(*two), W.join(*two[::-1])):
        assert W.expression(w) == "<><div>#<h2>#</>?<p>#</>+</><hr></>?</>"
    mixed = W.join(W.page_tree("<p>a</p><h2>b</h2>"), W.page_tree("<h2>b</h2><p>a</p>"))
    assert W.expression(mixed) == "<>(<p>#</>?<h2>#</>?)+</>"
    assert W.expression(W.page_tree("<p>a</p><h2>b</h2><p>c</p><hr><h2>d</h2>")) == "<>(<p>#</>?<h2>#</>?<hr></>?)+</>"


def test_labels_are_unique_after_any_join():
    import random

    rnd = random.Random(4)
    pages = ["".join(rnd.choice(["<p>a</p>", "<h2>b</h2>", "<div><p>c</div>", "<ul><li>d<li>e</ul>", "<hr>"]) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    whole = W.page_tree("")
    for p in pages:
        whole = W.join(whole, W.page_tree(p))
        labels = [n[0] for g in whole[4] for n in g[1]]
        assert len(labels) == len(set(labels)) <= 5


def test_main_text_without_what_stands_beside_it():
    assert W.read_by(PAGE, set(W.main_paths(W.page_tree(PAGE)))) == TEXT


def test_pages(spark):
    host, other = "https://a.example.org:80/x", "http://u@B.example.org/?q"
    rows = [
        (1, host, PAGE, "t"),
        (2, host, "<body><main><article><p>only this</p></article></main>", "t"),
        (3, host, "<p>no article here</p><nav>menu</nav>", "t"),
        (4, other, None, "t"),
        (5, other, "", "t"),
        (6, None, "plain &lt;text&gt;\n with   spaces", "t"),
        (6, None, "plain &lt;text&gt;\n with   spaces", "t"),
        (7, other, "<div class=content><p>x</p>" + "<p>long text</p>" * 3000 + "</div><div class=related>y</div>", "t"),
        (None, other, "<div class=content>broken <p <b>y", "t"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "1 as host", "2 as tree")
    got = W.extract(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert texts[1] == TEXT and texts[2] == "only this" and texts[3] == "no article here" and texts[4] == texts[5] == ""
    assert texts[6] == "plain <text> with spaces" and texts[7] == "\n".join(["x"] + ["long text"] * 3000)
    assert W.extract(pages.limit(0)).count() == 0


def test_partial_wrappers_lead_to_one_per_host(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "'http://one/' as url", "html")
    rows = W.wrappers(pages, salts=4).collect()
    assert [r.host for r in rows] == ["one"] and rows[0].pages == pages.count()
    assert W.main_paths(json.loads(rows[0].tree)) == ["/html/body/article"]
