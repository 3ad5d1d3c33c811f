import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import boosting, html_extract as h
from tallyspark.llm.html_samples import sample


@pytest.fixture(scope="module")
def model():
    return h.trained()


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    fitted = boosting.fit(x[:3000], y[:3000], share=1.0)
    assert np.mean((fitted.margin(x[3000:]) > 0) == (y[3000:] > 0)) > 0.95


def brute_decode(tree, margin):
    """The best of all keep and drop choices without a kept node below a dropped one."""
    n, best = len(tree.parent), (-np.inf, None)
    for bits in range(1 << n):
        kept = [bool(bits >> k & 1) for k in range(n)]
        if all(kept[tree.parent[k]] or not kept[k] for k in range(1, n)):
            score = sum(-np.logaddexp(0, -m if k else m) for k, m in zip(kept, margin))
            best = max(best, (score, kept), key=lambda b: b[0])
    return [t for t, k in zip(tree.text, best[1]) if k and t is not None]


def test_decoding_is_the_likeliest_consistent_choice():
    rng = np.random.default_rng(1)
    for _ in range(60):
        tree = h.Tree()
        tree.add(-1, "#page")
        for k in range(rng.integers(1, 9)):
            tree.add(int(rng.integers(0, k + 1)), "div", (), f"t{k}")
        margin = rng.normal(0, 2, len(tree.parent))
        assert h.decode(tree, margin) == brute_decode(tree, margin)


def test_parsing():
    texts = lambda page: [t for t in h.parse(page).text if t]
    assert texts("<p>a<p>b &amp; c&eacute; &#x41; &am") == ["a", "b & cé A &am"]
    assert texts("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert texts("<script>var a='<p>x</p>'</script>y<!-- <p>z</p> -->w<style>q") == ["yw"]  # a comment is nothing, not a blank
    assert texts("<script>1</script>y") == ["y"]
    assert texts("<html><head><meta a=1><title>T</title><style>s</style><p>a<div>b</div>") == ["a", "b"]
    assert texts("<head><title>T</title></head>a") == ["a"] and texts("<head><script>1</script><body>a") == ["a"]
    assert texts("<p>a<svg/>b<select>c") == ["a b c"] and texts("<svg>1</svg>d") == ["d"] and texts("<video src=x><p>e") == ["e"]
    assert texts("a  \n\t b<br>c<b>d</b>e</div></p>") == ["a b cde"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("1 < 2 <p title='>'>x</p") == ["1 < 2", "x"]
    assert texts("") == [] and texts("<") == ["<"] and texts("<p") == []


def test_stray_tags_take_linear_time():
    import time

    start = time.monotonic()
    h.parse("<div>" * 50_000 + "</p>" * 50_000 + "<video>" * 20_000 + "x")
    assert time.monotonic() - start < 10


PAGE = """<html><head><title>T</title></head><body><header class="site-header"><a href=/>Logo</a></header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all.</div><div id="content"><article><h1>The title</h1><p>First  paragraph of the text, with a <a href=x>link</a> in it. And more of it.</p>
<div class="ad">Buy this now.</div><p>Second paragraph of the text &amp; its end, which is longer than others.</p></article></div><aside class="sidebar"><h3>Related</h3><ul><li><a href=1>One</a></li></ul></aside>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this. It was good.</p></div></section><form class="newsletter"><p>Subscribe here.</p><button>Go</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_page_with_everything(model):
    assert model.extract([PAGE]) == ["The title\nFirst paragraph of the text, with a link in it. And more of it.\nSecond paragraph of the text & its end, which is longer than others."]


def test_unseen_pages(model):
    rng = np.random.default_rng(555)
    pages = [sample(rng) for _ in range(200)]
    hit = wrong = missed = 0
    for (_, main), text in zip(pages, model.extract([p for p, _ in pages])):
        got = set(text.split("\n")) - {""}
        hit, wrong, missed = hit + len(got & main), wrong + len(got - main), missed + len(main - got)
    assert wrong / (hit + wrong) < 0.03 and missed / (hit + missed) < 0.03


def test_operator(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE), (3, "u", "<nav>" * 3000 + "x"), (4, "u", "<article><h1>T</h1>" + "<p>Some words of text are here.</p>" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Text", F.lit("clash"))
    out = [(r.page_id, r.text, r.n_chars) for r in h.main_texts(df).collect()]
    assert len(out) == 6 and all(n == len(t) for _, t, n in out)
    assert out[0] == out[3] and out[1][1] == out[2][1] == "" and out[5][1].count("\n") == 2000
    assert h.main_texts(df.limit(0)).count() == 0
