import itertools
import random

from hazardlake.llm import html as H

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice">We use cookies, please accept them all now.</div><script>var x="</p>";</script>
<div id="content"><h2>Title here</h2><p>This is a long paragraph, with many words, about something that matters to readers.</p>
<p>Short one.</p><div class="ad">Buy now!</div><p>Another paragraph &lt;b&gt; with a&nbsp;b &amp; c. 1 < 2 it
   <b>says</b>.</p></div><form><input><button>Send</button> Name please</form>
<aside>Read more things here, and there, and everywhere, all of it interesting.</aside>
<section id="comments"><article><p>I like this article, it was nice and long and such.</p></article></section>
<footer>&copy; 2020 all</footer></body></html><div class="trunc"""


def cost(odds, edges, label):
    return sum(-o if o < 0 and k else o if o > 0 and not k else 0 for o, k in zip(odds, label)) + sum(w for a, b, w in edges if label[a] != label[b])


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        best = min(cost(odds, edges, x) for x in itertools.product([0, 1], repeat=n))
        assert abs(cost(odds, edges, H.min_cut(odds, edges)) - best) < 1e-9


def test_page_with_every_kind_of_boilerplate():
    assert H.main_text(PAGE)[0] == ("Title here\nThis is a long paragraph, with many words, about something that matters to readers.\n"
                                    "Short one.\nAnother paragraph <b> with a b & c. 1 < 2 it says.")


def test_odd_pages(spark):
    long = "<article>" + "<p>Some words, and more of them.</p>" * 5000
    rows = [(1, None, "a"), (2, "", "b"), (3, "<p", None), (4, "<div>&amp</div>", "c"), (5, long, "d"), (None, "<!-- x", "e"), (1, None, "a")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert got[1].text == got[2].text == got[3].text == "" and got[1].n_chars == 0
    assert got[5].text == "\n".join(["Some words, and more of them."] * 5000)
    assert H.extract(df).count() == len(rows) and H.extract(df.limit(0)).count() == 0


def test_pages_equal_their_article(spark):
    import html
    import re

    for r in H.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"<h1>|</h1>|<p>|</p>|<br>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
