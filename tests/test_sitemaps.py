"""Sitemaps: XML as it comes, indexes that lead to others, and what is no sitemap."""

from placelake.sources import sitemaps as M

SPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def urlset(*locs, space=SPACE):
    return f"<urlset {space}>" + "".join(f"<url><loc>{x}</loc><lastmod>2024-01-01</lastmod></url>" for x in locs) + "</urlset>"


def index(*locs):
    return f"<?xml version='1.0' encoding='UTF-8'?>\n<sitemapindex {SPACE}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


CASES = {
    "plain": (urlset("https://s.org/a", " \n https://s.org/b \t"), ["https://s.org/a", "https://s.org/b"]),
    "one": (urlset("https://s.org/a"), ["https://s.org/a"]),
    "coded": (urlset("https://s.org/?a=1&amp;b=&#50;", "<![CDATA[https://s.org/?x&y]]>"), ["https://s.org/?a=1&b=2", "https://s.org/?x&y"]),
    "prefixed": (f'﻿<!-- c --><s:urlset {SPACE.replace("xmlns", "xmlns:s")}><s:url><s:loc>https://s.org/p</s:loc></s:url></s:urlset>', ["https://s.org/p"]),
    "blank": (urlset("", "  ", "https://s.org/x"), ["https://s.org/x"]),
    "other space": (urlset("https://s.org/a", space='xmlns="http://other.org/"'), []),
    "no space": (urlset("https://s.org/a", space=""), []),
    "broken": (urlset("https://s.org/a")[:-9], []),
    "html": ("<html><body>not found</body></html>", []),
    "empty": ("", []),
    "null": (None, []),
}


def test_entries(spark):
    df = spark.createDataFrame([(k, xml, 1) for k, (xml, _) in CASES.items()], "name string, xml string, loc_ int")
    got = {k: [] for k in CASES}
    for r in M.entries(df).collect():
        assert not r.is_index and r.loc_ == 1
        got[r.name].append(r.loc)
    assert got == {k: want for k, (_, want) in CASES.items()}


def test_follow(spark):
    s = "https://s.org"
    documents = [
        (f"{s}/robots.txt", f"User-agent: *\r\n  SiteMap: {s}/deep/index.xml \r\nsitemap:\nDisallow: /"),
        (f"{s}/sitemap.xml", urlset(f"{s}/locations/a", f"{s}/about")),
        (f"{s}/deep/index.xml", index(f"{s}/deep/index.xml", f"{s}/deep/two.xml", f"{s}/gone.xml")),
        (f"{s}/deep/two.xml", index(f"{s}/deep/three.xml")),
        (f"{s}/deep/three.xml", urlset(f"{s}/locations/", f"{s}/locations/a", "https://elsewhere.org/facility/b")),
        (f"{s}/unasked.xml", urlset(f"{s}/locations/never")),
        ("https://t.org/sitemaps.xml", urlset("https://t.org/directory")),
        (None, "x"), (f"{s}/sitemap_index.xml", None),
    ]
    docs, sites = spark.createDataFrame(documents, "url string, xml string"), spark.createDataFrame([(f"{s}/home",), ("https://t.org",), (None,)], "site string")
    home, deep = f"{s}/home", f"{s}/deep/three.xml"
    want = {(home, f"{s}/locations/a"): f"{s}/deep/three.xml", (home, f"{s}/about"): f"{s}/sitemap.xml", (home, f"{s}/locations/"): deep, (home, "https://elsewhere.org/facility/b"): deep, ("https://t.org", "https://t.org/directory"): "https://t.org/sitemaps.xml"}
    assert {(r.site, r.url): r.source for r in M.follow(docs, sites).collect()} == want
    first = {k: v for k, v in want.items() if v != deep} | {(home, f"{s}/locations/a"): f"{s}/sitemap.xml"}
    assert {(r.site, r.url): r.source for r in M.follow(docs, sites, 2).collect()} == first
    kinds = {r.url: r.kind for r in M.places(M.follow(docs, sites)).collect()}
    assert kinds == {f"{s}/locations/a": "detail", f"{s}/locations/": "listing", "https://t.org/directory": "listing"}
    assert M.follow(docs.limit(0), sites).count() == M.follow(docs, sites.limit(0)).count() == 0
