import html as entities
import re

import numpy as np

from reviewrec.llm import html


def expected(page):
    """Pages of the test tables: all of the article, tags ending blocks but <b> and <br>."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div|ul|li)[^>]*>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
    return "\n".join(t for b in blocks if (t := " ".join(entities.unescape(b).split())))


def test_leaves():
    page = "<html><head><title>no</title></head><body><!-- x --><p>a <b>b</b>c<br>d<p>e&amp;f &nbsp; g<script>var t='</p>'</script><ul><li>one<li>two</ul>tail &lt;x&gt;"
    assert [x.text for x in html.leaves(page)] == ["a bc d", "e&f g", "one", "two", "tail <x>"]
    want = [0] * html.PATH
    for tag in ("html", "body", "ul", "li"):
        for at, sign in html.votes(tag):
            want[at] += sign
    assert html.leaves(page)[3].path.tolist() == want
    assert html.leaves("") == [] and html.leaves("<div><p></p></div><!-- never closed") == []
    assert [x.text for x in html.leaves('a < b <c d="x>y">z</c>')] == ["a < b z"]


def test_gradients():
    r = np.random.RandomState(0)
    net = html.Labeller.fresh(3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, mask = html.padded(r.randn(9, html.INPUT), [4, 5])
    y = (r.rand(*mask.shape) > 0.5) * mask
    _, grads = net.gradients(x, mask, y)
    for name, g in grads.items():
        at = tuple(r.randint(n) for n in g.shape)
        kept = net.weights[name][at]
        side = []
        for e in (1e-3, -1e-3):
            net.weights[name][at] = kept + e
            side.append(net.gradients(x, mask, y)[0])
        net.weights[name][at] = kept
        assert abs((side[0] - side[1]) / 2e-3 - g[at]) < 2e-3


def test_generated_pages_held_out():
    pages, labels = html.generated(300, 5)
    net = html.train(pages, labels)
    other, truth = html.generated(100, 6)
    right = total = 0
    for p, y in zip(other, truth):
        x, mask = html.padded(html.features([p]), [len(p)])
        right += ((net.logits(x, mask)[:, 0] > 0) == np.array(y, bool)).sum()
        total += len(p)
    assert right / total > 0.97


def test_query(spark, sf):
    want = {r.page_id: expected(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html.op3_html_extraction(spark, sf).collect()
    assert len(got) == len(want)
    assert np.mean([r.text == want[r.page_id] for r in got]) > 0.99
    assert all(r.n_chars == len(r.text) for r in got)


def test_edges(spark):
    long = "<article>" + "".join(f"<p>Some words of paragraph {k} that go on for a while.</p>" for k in range(3000)) + "</article>"
    rows = [(1, None, "u"), (2, "", "u"), (3, "<nav><a href='/'>Home</a></nav>", "u"), (4, long, "u"), (4, long, "u"), (None, "<article><p>Text of an article, long enough.</p></article>", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html.extract(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 6 and by[1] == "" and by[2] == "" and by[3] == "" and by[4].count("\n") == 2999
    assert html.extract(df.limit(0)).count() == 0


def test_deep_and_broken_pages_take_linear_time():
    import time

    began = time.time()
    deep = html.leaves("<div>" * 100_000 + "x" + "</div>" * 100_000)
    open_ = html.leaves("".join(f"<div class=c{'abcdefghij'[k % 10]}>x{k}" for k in range(50_000)))
    html.leaves("</p></span>" * 50_000 + "<p>y")
    html.leaves("<a <a <b " * 100_000)
    html.leaves("<head>" * 20_000 + "text")
    assert [x.text for x in deep] == ["x"] and len(open_) == 50_000 and time.time() - began < 30
