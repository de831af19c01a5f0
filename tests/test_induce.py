"""Schemas that are induced from listings, and the whole cascade."""

from placelake.operators import induce as I

CARD = '<section class="k wide"><h3><a href="/x">{0}</a></h3><p class="st">{1} Oak Street</p><p class="csz">Austin, TX 787{1}</p><span>Tel: (512) 555-01{1}</span></section>'
ROW = "<tr><td><b>{0}</b></td><td>{1} Elm Road</td><td class='c'>Reno, NV 895{1}</td></tr>"
NAMES = ["Oak Manor", "Elm Court", "Fir Lodge"]


def page(form, names=NAMES, extra=""):
    return f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/about'>About</a></li></ul></nav>{extra}<table class='t'>" * (form is ROW) + f"<html><body>{extra}" * (form is CARD) + "".join(form.format(n, 10 + i) for i, n in enumerate(names)) + "</body></html>"


PAGES = [
    (1, "https://a.org/1", page(CARD)),
    (2, "https://a.org/2", page(CARD, ["Ash House", "Bay House"], "<section class='k'><h3>News</h3></section>")),
    (3, "https://b.org/1", page(ROW)),
    (4, "https://c.org/1", page(CARD, ["Only One"])),
    (5, "https://d.org/1", "<html><ul><li>one</li><li>two</li><li>three</li></ul></html>"),
    (6, "https://e.org/1", None),
    (7, None, page(CARD)),
    (8, "https://f.org/1", '<div class="facility"><h2>Elm Care Center</h2><p>12 Pine Street</p> Reno NV 89501 (775) 555-0100</div>'),
]


def test_induce(spark):
    df = spark.createDataFrame(PAGES, "page_id int, url string, html string").repartition(3)
    got = {r.domain: (r.base, r.fields) for r in I.induce(df).collect()}
    assert got == {
        "a.org": ("section.k.wide", {"name": "a", "address": "p.st", "city_state_zip": "p.csz", "phone": "span"}),
        "b.org": ("table.t tr", {"name": "b", "address": "td:nth-child(2)", "city_state_zip": "td.c"}),
    }
    assert I.induce(df.limit(0)).count() == 0


def test_hybrid(spark):
    df = spark.createDataFrame(PAGES, "page_id int, url string, html string")
    got = {r.page_id: (r.method, [(x.name, x.address, x.city, x.state, x.zip_code, x.phone) for x in r.records]) for r in I.hybrid(df).collect()}
    assert set(got) == {p[0] for p in PAGES}
    assert got[1] == ("generated_schema", [(n, f"{10 + i} Oak Street", "Austin", "TX", f"787{10 + i}", f"Tel: (512) 555-01{10 + i}") for i, n in enumerate(NAMES)])
    assert got[2][0] == "generated_schema" and [x[0] for x in got[2][1]] == ["Ash House", "Bay House"]
    assert [x[0] for x in got[3][1]] == NAMES and got[3][1][0][1:5] == ("10 Elm Road", "Reno", "NV", "89510")
    assert got[5] == got[6] == ("none", [])
    assert got[8][0] == "regex_extraction" and got[8][1][0][0] == "Elm Care Center"
    assert I.hybrid(df.limit(0)).count() == 0
