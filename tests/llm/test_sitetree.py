import time

import pytest

from factorloom.llm import sitetree


@pytest.mark.parametrize("page", ["<a " * 100_000, "<div>" * 100_000, "<a \"" * 100_001 + ">", "<a '>" * 100_001, "<button>" * 100_000, "<!-" * 100_000, "</p>" * 100_000, "<p class=x>" * 50_000 + "</p>" * 50_000])
def test_time_is_linear(page):
    begin = time.time()
    sitetree.blocks(page + "x")
    assert time.time() - begin < 2


def test_pieces():
    got = list(sitetree.pieces("a < b <!-- c --><p class='x>y'>d<script>e</script >f<br/>g</P><button>x<p>two"))
    assert got == [("", False, "a < b "), ("p", False, " class='x>y'"), ("", False, "d"), ("", False, "f"), ("br", False, "/"), ("", False, "g"), ("p", True, ""), ("", False, "x"), ("p", False, ""), ("", False, "two")]
    assert [x.text for x in sitetree.blocks("one<button>x<p>two<p>three")] == ["onex", "two", "three"]
    assert list(sitetree.pieces("<style>never ends <p>x</p>")) == [] and list(sitetree.pieces("a <b")) == [("", False, "a <b")]


def rows():
    page = lambda i: f"<nav>menu</nav><article><p>own text {i}</p><div class=block>Read this first</div></article><footer>f</footer>"
    out = [(i, f"http://h/{i}", page(i)) for i in range(8)]
    return out + [(100, None, page(100)), (101, "http://one/1", page(101)), (102, "x", None), (102, "x", None), (103, "x", "<p>" + "long &amp; " * 100_000)]


def plain_importance(pages):
    """(host, node) -> (pages, importance) by counting, in plain Python."""
    import math

    seen: dict = {}
    for url, html in {(u, h) for _, u, h in pages}:
        bs = sitetree.blocks(html or "")
        for node in {b.node for b in bs}:
            parent = next(b.parent for b in bs if b.node == node)
            content = " ".join(b.text for b in bs if b.node == node)
            look = tuple(b.node for b in bs if b.parent == parent)
            seen.setdefault((sitetree._host(url), node), {})[html or ""] = (content, look)
    out = {}
    for key, by_page in seen.items():
        n = len(by_page)
        entropy = lambda k: -sum(c / n * math.log(c / n) for c in [sum(v[k] == x for v in by_page.values()) for x in {v[k] for v in by_page.values()}]) / math.log(n)  # noqa: B023, E731
        out[key] = (n, 0.9 * entropy(0) + 0.1 * entropy(1) if n > 1 else 1.0)
    return out


def test_importance_matches_plain_counting(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    got = {(r.host, r.node): (r.n_pages, r.importance) for r in sitetree.style_tree(pages).collect()}
    want = plain_importance(rows())
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_both_lookups_agree_and_entropy_matters(spark, monkeypatch):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumnRenamed("page_id", "page_id")
    got = sorted((r.page_id, r.text) for r in sitetree.extract(pages).collect())
    assert got[:8] == [(i, f"own text {i}") for i in range(8)]
    assert got[8:10] == [(100, "own text 100 Read this first"), (101, "own text 101 Read this first")] and got[10:12] == [(102, ""), (102, "")]
    assert got[12] == (103, ("long & " * 100_000).strip())
    monkeypatch.setattr(sitetree, "BROADCAST_NODES", 0)
    assert sorted((r.page_id, r.text) for r in sitetree.extract(pages).collect()) == got
    monkeypatch.setattr(sitetree, "MIN_PAGES", 1000)
    assert sorted((r.page_id, r.text) for r in sitetree.extract(pages).collect())[0] == (0, "own text 0 Read this first")


def test_sample_pages_depend_on_the_tree(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    nodes = sitetree.style_tree(pages.select("url", "html")).where(f"n_pages >= {sitetree.MIN_PAGES}")
    assert nodes.count() > 0
