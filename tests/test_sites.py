"""Anchors, staged discovery and numbering."""

import random

from placelake.functions import dom
from placelake.functions.anchors import anchors, join
from placelake.operators import discover as S
from placelake.operators import links as L
from placelake.operators.rounds import numbered

FOUR = """<a href='/x'>One</a> <A HREF="/y">Two <b>bold</b></A><a href=/z>3 &lt; 4</a><a class=q title="a > b" href="/w&amp;v">W</a><!-- <a href="no">no</a> --><script>"<a href=q>"</script><a name=n>no</a>"""


def test_anchors(spark):
    pages = spark.createDataFrame([(1, "https://s.org/a/b", FOUR), (2, "https://s.org", None), (3, None, '<a href="/r">r</a><a href="https://t.org/">t</a>'), (4, "http://[", '<a href="x">x</a>')], "page_id int, url string, html string")
    got = sorted((r.page_id, r.pos, r.href, r.text, r.url) for r in L.anchors(pages).collect())
    assert got[:4] == [(1, 0, "/x", "One", "https://s.org/x"), (1, 1, "/y", "Two bold", "https://s.org/y"), (1, 2, "/z", "3 < 4", "https://s.org/z"), (1, 3, "/w&v", "W", "https://s.org/w&v")]
    assert got[4:] == [(3, 0, "/r", "r", None), (3, 1, "https://t.org/", "t", "https://t.org/"), (4, 0, "x", "x", None)]
    assert L.links(pages.limit(0)).count() == 0
    assert join("https://s.org/a/b?q#f", "../c") == "https://s.org/c"


def test_anchors_as_in_tree():
    """The tokenizer finds the anchors that the tree has, over random markup."""
    rng = random.Random(1)
    pieces = ['<a href="/%d">', "<A HREF='/q?a=1&amp;b=%d'>", "<a class=x href=/u%d>", "</a>", "<div>", "</div>", "text%d ", '<img alt="<a href=no>" src=x%d>', '<!-- <a href="c%d"> -->', '<script>var a="<a href=x%d>";</script>', "<br>", "<b>", "</b>", "&lt;%d&gt;", "<a name=%d>", "<span title='a \"b\" %d'>", "</span>", "<style>a{%d}</style>", '<a title="href=%d" href = "h">']
    for i in range(1500):
        html = "".join(p % i if "%d" in p else p for p in (rng.choice(pieces) for _ in range(rng.randint(1, 14))))
        assert [h for h, _ in anchors(html)] == [x.attrs["href"].strip() for x in dom.select(dom.parse(html), "a[href]")], html
    assert anchors("<a " * 200000) == [] and len(anchors('<a href="x">' * 20000)) == 20000


def page(*hrefs, menu=(), body=""):
    link = lambda h: f'<a href="{h}">go</a>'
    return f"<html><body><nav>{''.join(map(link, menu))}</nav>{''.join(map(link, hrefs))}{body}</body></html>"


SITE = {
    "https://s.org/": page("/about-us", "/deep", "https://t.org/locations/x", "/careers/locations", menu=["/locations/", "/team"], body='<form action="/find"><input name="zip">Find a location</form><script>fetch("/api/locations.json")</script>'),
    "https://s.org/about-us": page("/locations/north", "/deep", "/"),
    "https://s.org/deep": page("/deeper"),
    "https://s.org/deeper": page("/deepest", "/communities/west"),
    "https://s.org/deepest": page("/locations/too-far"),
    "https://s.org/locations/north": page("/locations/behind-a-place"),
}


def test_discover(spark):
    rows = [*SITE.items(), ("https://s.org/broken", None), (None, page("/locations/q"))]
    pages = spark.createDataFrame([(u, h, True) for u, h in rows] + [("https://s.org/team", page("/locations/unseen"), False)], "url string, html string, success boolean")
    told = spark.createDataFrame([("https://s.org/", "https://s.org/facilities/map", "https://s.org/sitemap.xml"), ("https://s.org/", "https://s.org/plain", "x"), ("https://u.org/", "https://u.org/locations/1", "x")], "site string, url string, source string")
    got = {r.url.removeprefix("https://s.org"): (r.kind, r.step, r.depth, r.source.removeprefix("https://s.org")) for r in S.discover(pages, spark.createDataFrame([("https://s.org/",), (None,), ("https://s.org/",)], "site string"), told).collect()}
    assert got == {
        "/facilities/map": ("detail", "sitemap", 0, "/sitemap.xml"),
        "/locations/": ("listing", "navigation", 0, "/"),
        "/find": ("endpoint", "search", 0, "/"),
        "/api/locations.json": ("endpoint", "search", 0, "/"),
        "/locations/north": ("detail", "links", 2, "/about-us"),
        "/communities/west": ("listing", "links", 3, "/deeper"),
    }
    assert S.discover(pages.limit(0), spark.createDataFrame([("https://s.org/",)], "site string")).count() == 0


def test_walk(spark):
    """Levels are met once, loops end, and a node with a kind stops."""
    rng = random.Random(2)
    edges = [(a, rng.randrange(60)) for a in range(60) for _ in range(2)]
    kind = {b: "detail" if b % 7 == 0 else None for b in range(60)}
    graph = spark.createDataFrame([(str(a), str(b), kind[b]) for a, b in set(edges)], "src string, dst string, kind string")
    for most in (2, None):
        level, passed, met, depth = {0}, {0: 0}, {}, 0
        while level and (most is None or depth < most):
            depth += 1
            after = set()
            for a, b in sorted(set(edges), key=lambda e: str(e[0])):
                if a in level and kind[b]:
                    met.setdefault(b, (depth, str(a)))
                elif a in level and b not in passed:
                    after.add(b)
            passed |= dict.fromkeys(after, depth)
            level = after
        a, b = S.walk(graph, spark.createDataFrame([("s", "0")], "site string, url string"), most)
        assert {int(r.url): (r.depth, r.source) for r in a.collect()} == met
        assert {int(r.url): r.depth for r in b.collect()} == passed


def test_scrape(spark):
    card = lambda u: f'<div class="facility-card"><a href="{u}">x</a></div>'
    site = {
        "https://s.org/": page("/our-locations", "/list?page=2"),
        "https://s.org/list?page=2": page("/list?page=3", "/facility/two"),
        "https://s.org/list?page=3": page("/facility/three"),
        "https://s.org/our-locations": "<html>" + card("/center/four") + card("/about") + "</html>",
        "https://s.org/facility/two": "<html><h1>Two House</h1></html>",
        "https://s.org/facility/three": "<html><h1>Three House</h1></html>",
        "https://s.org/center/four": "<html><h1>Four House</h1></html>",
        "https://s.org/facility/none": "<html><h1>Nobody leads here</h1></html>",
    }
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())], "page_id int, url string, html string")
    got = {r.page_url.removeprefix("https://s.org"): r.name for r in S.scrape(pages, spark.createDataFrame([("https://s.org/",)], "site string")).collect()}
    assert {k: v for k, v in got.items() if k != "/our-locations"} == {"/facility/two": "Two House", "/facility/three": "Three House", "/center/four": "Four House"}


def test_numbered(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50) if i % 11 else None, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    out = numbered(df, "a")
    got = sorted((r.number, r.a) for r in out.collect())
    assert [n for n, _ in got] == list(range(1000))
    assert [a for _, a in got] == sorted((a for a, _ in rows), key=lambda a: (a is not None, a))
    assert sorted(r.b for r in out.collect()) == list(range(1000))
    assert numbered(df.limit(0), "a").count() == 0
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
