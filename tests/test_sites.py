"""Resolution, asset discovery, rewriting and the crawl's queue against plain versions."""

import random
from collections import deque
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.operators import assets, crawl


def test_resolution_against_the_library(spark):
    r = random.Random(1)
    bases = ["http://a.example/b/c/d?q#f", "https://A.example", "http://a.example/", "http://a.example/x//y/", "http://u@h:80/a/../b/./c", "https://a.example/p?x=/y"]
    atoms = ["..", ".", "/", "//", "a", "b.css", "?", "x=1", "#", "f", " ", ":", "http:", "https:", "mailto:", "data:", "", "h.example", "\n", "é", "%20", "1a"]
    refs = ["".join(r.choice(atoms) for _ in range(r.randint(0, 7))) for _ in range(2500)] + ["//[x/y", "http://[::1]/a", "//[::1]:80/a/../b", "http:g", "//${n.value}/x.js", "//[${n}]/x.js"]
    rows = [(r.choice(bases), x) for x in refs]

    def want(base, ref):
        try:
            return urljoin(base, ref)
        except ValueError:
            return None

    got = spark.createDataFrame([*rows, (None, "a"), ("http://a.example/", None)], "b string, r string").select("b", "r", urls.resolved(F.col("b"), F.col("r")).alias("u"), urls.rooted_join(F.col("b"), F.col("r")).alias("v")).collect()
    for g in got:
        assert g.u == (want(g.b, g.r) if g.b and g.r is not None else None) and g.v == g.u, (g.b, g.r)


def harvested(spark, text, base="https://s.example/p/q", mapped=False):
    df = spark.createDataFrame([(base, text), (base, None), ("https://s.example/other", "")], "url string, text string")
    return {(r.kind, r.ref, r.asset_url) for r in assets.harvest(df, mapped=mapped).collect()}


def test_harvest(spark):
    text = """<img src="a/../b.png?x=1&amp;y=2" srcset='c.webp 1x, d.webp 2x'> @import url( "../e.css" ); import("./f.mjs") from `g.js`
    https://far.example/h.woff2?v=1)tail "https://far.example/page" href='mailto:i.css' href="//far.example/j.png#k" new URL( 'l.wasm', x) src="m" src='data:n.png' import(`${i.value}.js`) import(`${t}.js`)"""
    got = harvested(spark, text)
    assert {(k, u) for k, _, u in got} == {
        ("attribute", "https://s.example/p/b.png?x=1&y=2"), ("srcset", "https://s.example/p/c.webp"), ("srcset", "https://s.example/p/d.webp"), ("css", "https://s.example/e.css"), ("module", "https://s.example/p/f.mjs"),
        ("module", "https://s.example/p/g.js"), ("absolute", "https://far.example/h.woff2?v=1"), ("attribute", "https://far.example/j.png"), ("module", "https://s.example/p/l.wasm"), ("module", "https://s.example/p/${t}.js"),
    }
    chunks = harvested(spark, '"static/chunks/ab-1.js" 12===e?"static/chunks/"+e+"-0a1b2c.js"', "https://s.example/x/_next/static/m.js")
    assert {u for k, _, u in chunks if k == "chunk"} == {"https://s.example/x/_next/static/chunks/ab-1.js", "https://s.example/x/_next/static/chunks/12-0a1b2c.js"}
    assert {k for k, _, _ in harvested(spark, '"static/chunks/ab-1.js"')} == set()


def test_import_maps(spark):
    """The whole reference first, then the longest entry with a slash, as written in the map; candidates of images know no map."""
    page = """<script type="importmap">{"imports": {"three": "https://c.example/t.js", "three/": "https://c.example/t/", "three/addons/": "./addons/", "lib": "x"}}</script>
    <script>import * from 'three'; import('three/a.js'); import('three/addons/b.js'); import('lib/c.js'); import('three/')</script><img srcset="three/d.png">"""
    got = {(k, r): u for k, r, u in harvested(spark, page, mapped=True)}
    assert got["module", "three"] == "https://c.example/t.js" and got["module", "three/a.js"] == "https://c.example/t/a.js" and got["module", "three/addons/b.js"] == "./addons/b.js"
    assert got["module", "lib/c.js"] == "https://s.example/p/lib/c.js" and got["srcset", "three/d.png"] == "https://s.example/p/three/d.png" and ("module", "three/") not in got
    assert ("module", "three/a.js", "https://s.example/p/three/a.js") in harvested(spark, page)


def test_rounds_that_leave_a_frontier(spark):
    pages = spark.createDataFrame([("https://s.example/", '<link href="0.css">')], "url string, html string")
    files = [(f"https://s.example/{k}.css", 200, "text/css", None, f'@import url("{k + 1}.css")'.encode() + b"\xff") for k in range(9)]
    fetched = spark.createDataFrame(files, "url string, status int, content_type string, error string, body binary")
    found, left = assets.fixpoint(pages, fetched, rounds=3)
    assert sorted((r.url[-5:], r.round) for r in found.collect()) == [("0.css", 0), ("1.css", 1), ("2.css", 2)] and [r.url[-5:] for r in left.collect()] == ["3.css"]
    found, left = assets.fixpoint(pages, fetched, rounds=30)
    assert found.count() == 10 and left.count() == 0


def plain_rewrite(text, own):
    """The longest pattern first, at all its places that no longer one has taken."""
    spans = []
    for p in sorted(own, key=lambda p: (-len(p), p)):
        at = text.find(p)
        while at >= 0:
            free = all(b <= at or a >= at + len(p) for a, b, _ in spans)
            if free:
                spans.append((at, at + len(p), own[p]))
            at = text.find(p, at + (len(p) if free else 1))
    out, last = "", 0
    for a, b, new in sorted(spans):
        out, last = out + text[last:a] + new, b
    return out + text[last:]


def test_rewriting_against_plain_replacement(spark):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("ab&/") for _ in range(n))
    pages = [(f"p{k}", r.choice([word(r.randint(0, 60)), "é" + word(40).replace("&", "&amp;")])) for k in range(120)] + [("null", None), ("none", "ab/ab"), ("p1", "ab")]
    own = [(f"p{k}", word(r.randint(1, 5)), f"<{r.randint(0, 9)}>") for k in range(120) for _ in range(r.randint(0, 6))] + [("p3", "", "x"), ("p4", "a", None)]
    got = assets.rewrite(spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame(own, "src_url string, asset_url string, place string"))
    want = []
    for url, html in pages:
        mine: dict = {}
        for u, a, p in own:
            if u == url and a and p is not None:
                for x in {a, a.replace("&", "&amp;")}:
                    mine[x] = min(p, mine.get(x, p))
        want.append((url, html and plain_rewrite(html, mine)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_relative_references_are_rewritten(spark):
    page = """<script type="importmap">{"imports": {"lib/": "https://c.example/l/"}}</script><img src=' a.png ' srcset="a.png 1x,b.png 2x"><script>import 'lib/x.js'; import("lib/x.js"); "a.png"</script>"""
    pages = spark.createDataFrame([("https://s.example/", page), ("https://t.example/", "no references")], "url string, html string")
    refs = assets.harvest(pages, "url", "html", mapped=True)
    places = refs.withColumn("place", F.concat(F.lit("cdn/"), F.substring_index("asset_url", "/", -1)))
    got = {r.url: r.html for r in assets.relative_rewrite(pages, places, "url", "html").collect()}
    assert got["https://s.example/"].endswith("""<img src='cdn/a.png' srcset="cdn/a.png 1x, cdn/b.png 2x"><script>import 'lib/x.js'; import("cdn/x.js"); "a.png"</script>""") and got["https://t.example/"] == "no references"


def plain_crawl(edges, start, sitemap, allowed, max_pages, max_depth, sitemap_first):
    """A queue, one page after the other."""
    links: dict = {}
    for s, o, d in edges:
        links.setdefault(s, []).append((o, d))
    queue, queued, pages = deque(), {start}, []

    def put(key, depth):
        if key not in queued and allowed.get(key) == "follow":
            queued.add(key)
            queue.append((key, depth))

    if sitemap_first:
        queue.append((start, 0))
        for _, key in sorted(sitemap):
            put(key, 1)
    else:
        queue.append((start, 0))
    while queue and len(pages) < max_pages:
        key, depth = queue.popleft()
        pages.append((key, depth, len(pages) + 1))
        if depth < max_depth:
            for _, d in sorted(links.get(key, [])):
                if depth or d not in {k for _, k in sitemap}:  # which has a place of its own
                    put(d, depth + 1)
        if depth == 0 and not sitemap_first and max_depth:
            for _, key in sorted(sitemap):
                put(key, 1)
    return sorted(pages), sorted([(k, "max-pages cap") for k, _ in queue] + [(k, why) for k, why in allowed.items() if why != "follow"])


@pytest.mark.parametrize("sitemap_first", [True, False])
def test_crawl_against_a_queue(spark, sitemap_first):
    r = random.Random(5)
    nodes = [f"n{k}" for k in range(60)]
    edges = [(s, o, r.choice(nodes)) for s in nodes[:50] for o in range(r.randint(0, 5))]
    allowed = {k: r.choice(["follow"] * 5 + ["robots"]) for k in nodes} | {"n0": "follow"}
    sitemap = [(o, k) for o, k in enumerate(r.sample(nodes[1:], 6))]
    frames = spark.createDataFrame(edges, "src string, ord int, dst string"), "n0", spark.createDataFrame(sitemap, "ord int, key string"), spark.createDataFrame(list(allowed.items()), "key string, reason string")
    for cap, depth in ((9, 3), (25, 2), (100, 5)):
        done, rest = crawl.crawl(*frames, cap, depth, sitemap_first)
        want = plain_crawl(edges, "n0", sitemap, allowed, cap, depth, sitemap_first)
        assert (sorted(map(tuple, done.collect())), sorted(map(tuple, rest.collect()))) == want
