"""Accessibility trees, table grids and profile links."""

from pyspark.sql import functions as F

from brindle.functions import links
from brindle.sources import pages, readers

TREES = "page_id long, nodes array<struct<id:string, parent:string, role:string, name:string, ignored:boolean, children:array<string>>>"


def grown(spec, parent=None, nodes=None):
    """Nodes of (role, name, children) or (role, name, children, ignored)."""
    nodes = [] if nodes is None else nodes
    role, name, kids, *ignored = spec
    me = [f"n{len(nodes)}", parent, role, name, bool(ignored and ignored[0]), []]
    nodes.append(me)
    for kid in kids:
        me[5].append(f"n{len(nodes)}")
        grown(kid, me[0], nodes)
    return nodes


def text_of(spark, *specs):
    rows = [(i, grown(s) if isinstance(s, tuple) else s) for i, s in enumerate(specs)]
    return [r["text"] for r in pages.tree_text(spark.createDataFrame(rows, TREES)).orderBy("page_id").collect()]


MAIN = ("main", "", [
    ("heading", "A page about suppliers", []),
    ("table", "", [
        ("row", "", [("columnheader", "Name", []), ("columnheader", "", [("StaticText", "City", [])])]),
        ("row", "", [("cell", "", [("link", "Acme", [("StaticText", "Acme", [])])]), ("cell", "", []), ("button", "not a cell", [])]),
        ("row", "", [("cell", "", []), ("cell", None, [])]),
    ]),
    ("list", "Offers", [("listitem", "", [("link", "Bolts", [("StaticText", "Bolts", [])]), ("generic", "", [("StaticText", "cheap", [])], True)]), ("listitem", "", [])]),
    ("article", "", [("heading", "Nuts", []), ("StaticText", "of steel", []), ("navigation", "", [("link", "more", [])])]),
    ("StaticText", "loose text", [("InlineTextBox", "loose", [])]),
    ("generic", "left out", [("button", "", []), ("paragraph", "", [("StaticText", "kept", [])])], True),
])
BODY = """heading "A page about suppliers"
table
  row: Name | City
  row: Acme | 
list "Offers"
  - Bolts cheap
article: Nuts ; of steel ; more
loose text
button
kept"""


def test_trees_as_lines(spark):
    page = ("RootWebArea", "Title", [("navigation", "", [("link", "Home", [])]), MAIN])
    short = ("RootWebArea", "T", [("banner", "", [("link", "Home", [])]), ("StaticText", "short", [])])
    dangling = [["a", None, "RootWebArea", None, False, ["b", "gone"]], ["b", "a", "StaticText", "x", False, None], ["c", "d", "link", "ring", False, ["d"]], ["d", "c", "link", "ring", False, ["c"]]]
    assert text_of(spark, page, short, [], dangling, None) == [BODY, 'link "Home"\nshort', "", "x", ""]
    deep = ("list", "", [("StaticText", "end", [])])
    for _ in range(70):
        deep = ("generic", "", [deep])
    assert text_of(spark, deep) == ["list\n  end"]
    r = spark.createDataFrame([(BODY,)], "t string").select(pages.item_estimate(F.col("t"))).first()
    assert r[0] == 1


def test_spans_spread_over_the_grid():
    html = """<table><tr><th>a<th colspan=2>b c<th>d</tr>
      <tr><td rowspan="3">1<td>2<td rowspan=2 colspan=2><p>3</p><p>4</p></tr><tr><td>5</td></tr><tr></tr><tr><td>6<table><tr><td>in</td></tr></table></td></tr>
      <tr><th>h<th>i</tr></table><table><script>no</script><td>x<noscript>y</noscript><td colspan="999" rowspan="z">w"""
    got = readers.html_tables(html)
    assert [g for g in got if g[0] == 0] == [(0, 0, False, ["in"])]
    assert [g[2:] for g in got if g[0] == 1] == [(True, ["a", "b c", "", "d"]), (False, ["1", "2", "3 4", ""]), (False, ["1", "5", "3 4", ""]), (False, ["6"]), (False, ["h", "i"])]
    assert [g[3] for g in got if g[0] == 2] == [["x", "w", *[""] * 49]]
    assert readers.html_tables("") == [] and readers.html_tables("<table></table>") == []


def test_profiles(spark):
    forms = {
        "https://instagram.com/u1/?hl=en": ("instagram", "https://www.instagram.com/u1/"), "http://www.instagram.com/Explore/tags": None, "https://instagram.com/explored": ("instagram", "https://www.instagram.com/explored/"), "https://instagram.com/": None,
        "https://m.facebook.com/profile.php?x=1&id=77#a": ("facebook", "https://www.facebook.com/profile.php?id=77"), "https://facebook.com/profile.php": None, "https://fb.com/shop.one/about": ("facebook", "https://www.facebook.com/shop.one"), "https://facebook.com/sharer.php?u=1": None,
        "https://in.linkedin.com/Company/acme/jobs": ("linkedin", "https://www.linkedin.com/company/acme"), "https://linkedin.com/feed/x": None, "https://wa.me/4912": ("whatsapp", "https://wa.me/4912"), "https://wa.me/abc": None,
        "https://api.whatsapp.com/send?text=a&phone=%2B49-12": ("whatsapp", "https://wa.me/4912"), "https://api.whatsapp.com/send?phone=x": None, "https://notinstagram.com/u": None, "https://x.org/?u=https://instagram.com/u": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(u,) for u in forms], "u string").select("u", links.profile_link(F.col("u")).alias("p")).collect()
    assert {r["u"]: r["p"] and tuple(r["p"]) for r in rows} == forms


def test_contacts_and_prints(spark):
    found = [[" Info@Mail.net,", "zoe@shop.org."], ["bob@mail.net", "sales@mail.net", "no-reply@shop.org"], ["x@example.com", "logo@2x.png", "a@b.wixpress.com"], ["hi@a.shop.org", "info@z.net"], []]
    want = ["zoe@shop.org", "sales@mail.net", "", "hi@a.shop.org", ""]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(found)], "i int, f array<string>").orderBy("i")
    assert [r[0] for r in rows.select(links.best_email(F.col("f"), F.lit("shop.org"))).collect()] == want
    years = spark.createDataFrame([("© 2015 – 2021 us, (c) 2019",), ("Copyright 1999",), ("copyright someone 2020",), ("&copy;2031-2032",), ("none 2020",)], "t string").select(links.copyright_year(F.col("t")))
    assert [r[0] for r in years.collect()] == [2021, 1999, None, 2032, None]
    marks = spark.createDataFrame([("<script src=//img1.wsimg.com/a>",), ("<a href=https://www.blogger.com>",), ("<link href=https://www.blogger.com/static/v1>",), ("/static/frontend/x",)], "t string").select(links.platform(F.col("t")))
    assert [r[0] for r in marks.collect()] == ["GoDaddy Website Builder", "", "Blogger", "Magento"]
