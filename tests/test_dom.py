"""Page elements against trees that the pages are written from, and against the standard library's parser on the given pages."""

from __future__ import annotations

import random
import re
from html import escape
from html.parser import HTMLParser

import pytest

from ledgerloom.sources import dom, files


def written(rng, node):
    """A page's text of a tree (tag, attributes, children), with quotes, order, case and white space as they come."""
    if isinstance(node, str):
        return escape(node, quote=False) if rng.random() < 0.7 else "".join(f"&#{ord(c)};" if rng.random() < 0.3 else escape(c, quote=False) for c in node)
    tag, attributes, children = node
    pairs = list(attributes.items())
    rng.shuffle(pairs)
    out = f"<{tag.upper() if rng.random() < 0.3 else tag}"
    for k, v in pairs:
        quote = rng.choice("\"'") if re.search(r"[\s>\"'=<`&/]", v) or not v or rng.random() < 0.7 else ""
        value = v.replace("&", "&amp;").replace('"', "&quot;").replace("'", "&#39;") if quote else v
        out += rng.choice([" ", "\n ", "  "]) + (k.upper() if rng.random() < 0.2 else k) + rng.choice(["=", " = "]) + f"{quote}{value}{quote}"
    out += rng.choice(["", " "]) + ">"
    if tag in dom.VOID:
        return out
    inside = "".join(written(rng, c) for c in children)
    return f"{out}{inside}</{tag}{rng.choice(['', ' '])}>" + rng.choice(["", "", "<!-- <p class='kie-field'>no</p> -->", "<script>var a = '<b>' < 1 && \"</p>\";</script>"])


def tree(rng, depth=0):
    tag = rng.choice(["div", "span", "section", "b", "br", "i"])
    attributes = {k: rng.choice(["kie-field", "x kie-field y", "other", "a>b", "it's", "", "kie-fields"]) if k == "class" else rng.choice(["SELLER", "a & b", "x y", 'say "so"', "1>0"]) for k in rng.sample(["class", "data-label", "id"], rng.randint(0, 3))}
    if tag == "br":
        return tag, attributes, []
    return tag, attributes, [tree(rng, depth + 1) if depth < 5 and rng.random() < 0.45 else rng.choice(["Total ", "1 < 2", "a&b", " \n ", "é世", "x  y"]) for _ in range(rng.randint(0, 4))]


def shown(node):
    if isinstance(node, str):
        return node
    tag, _, children = node
    if tag == "br":
        return "\0"
    inner = "".join(map(shown, children))
    return f"\0{inner}\0" if tag in ("div", "section") else inner


def fields(node, out):
    if not isinstance(node, str):
        tag, attributes, children = node
        if "kie-field" in attributes.get("class", "").split():
            lines = [" ".join(line.split()) for line in shown(node).split("\0")]
            out.append((tag, attributes, "\n".join(line for line in lines if line)))
        for c in children:
            fields(c, out)
    return out


def test_fields_of_made_pages(spark):
    rng = random.Random(11)
    trees = [[tree(rng) for _ in range(rng.randint(0, 4))] for _ in range(150)]
    rows = [(k, "".join(written(rng, n) for n in t), "clash") for k, t in enumerate(trees)] + [(900, None, "clash"), (901, "", "clash")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    want = [(k, p, *e) for k, t in enumerate(trees) for p, e in enumerate([f for n in t for f in fields(n, [])])]
    got = [(r.page_id, r.place, r.tag, r.attributes, r.text) for r in dom.elements(df, css_class="kie-field").collect()]
    assert sorted(got, key=lambda r: r[:2]) == want
    labels = [(k, p, a.get("data-label"), s) for k, p, _, a, s in want]
    assert sorted(map(tuple, files.page_fields(df, blank=True).collect())) == labels
    assert sorted(map(tuple, files.page_fields(df).collect())) == [r for r in labels if r[3]]


@pytest.mark.parametrize("html,want", [
    ("<p data-label=\"A\" class='kie-field'>x <p>y</p> z</p>", [("A", "x")]),
    ("<div data-label=A class=kie-field>x <div>y</div> z</div>", [("A", "x\ny\nz")]),
    ("<ul><li class=kie-field data-label=1>a<ul><li>b</ul>c<li class=kie-field data-label=2>d</ul>e", [("1", "a\nb\nc"), ("2", "d")]),
    ("<table><tr class=kie-field data-label=r><td>a<td>b<tr><td>c</table>", [("r", "a\tb")]),
    ("<span class=kie-field data-label=s>a<br/>b<img class=kie-field data-label=i>c", [("s", "a\nbc"), ("i", "")]),
    ("<b class='kie-field' data-label='x' data-label='y'>&eacute;&nbsp;&#x41;&lt;p></b>", [("x", "é A<p>")]),
    ("<div class=kie-field data-label=a>x<style>p{}</style><!-- y --><SCRIPT>z</script ></div>", [("a", "x")]),
    ("<div class=kie-field data-label=open>never closed", [("open", "never closed")]),
    ("<div class=kie-field data-label='never ends>x</div>", []),
    ("a < b <1> </> <div class=\tkie-field\n>ok</ div></div>", [(None, "ok")]),
    ("</p></div><b class=kie-field>x</i></b>", [(None, "x")]),
    ("<p class=kie-field><b>bold<p class=kie-field>next", [(None, "bold"), (None, "next")]),
])
def test_single_pages(spark, html, want):
    rows = files.page_fields(spark.createDataFrame([(1, html)], "page_id long, html string"), blank=True).orderBy("place").collect()
    assert [(r.label, r.text) for r in rows] == want


class Plain(HTMLParser):
    """Elements h1, p, li, a of pages whose only elements left open are paragraphs and what stands in them."""

    WANTED = ("h1", "p", "li", "a")

    def __init__(self):
        super().__init__()
        self.stack, self.found = [], []  # (tag, its text's pieces or null)

    def handle_starttag(self, tag, attrs):
        names = [t for t, _ in self.stack]
        if tag in dom.P_ENDERS and "p" in names:
            del self.stack[names.index("p") :]
        if tag == "br":
            self.handle_data("\0")
        elif tag not in dom.VOID:
            pieces = [] if tag in self.WANTED else None
            self.stack.append((tag, pieces))
            if pieces is not None:
                self.found.append((tag, pieces))

    def handle_endtag(self, tag):
        names = [t for t, _ in self.stack]
        if tag in names:
            del self.stack[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if not any(t in ("script", "style") for t, _ in self.stack):
            for _, pieces in self.stack:
                if pieces is not None:
                    pieces.append(data)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = [tuple(r) for r in files.page_elements(pages, ["h1", "p", "li", "a"]).collect()]
    want = []
    for r in pages.collect():
        parser = Plain()
        parser.feed(r.html)
        parser.close()
        for place, (tag, pieces) in enumerate(parser.found):
            lines = [" ".join(re.split(r"[ \t\n\r\f\xa0]+", line)).strip() for line in "".join(pieces).split("\0")]
            want.append((r.page_id, place, tag, "\n".join(line for line in lines if line)))
    assert sorted(got) == sorted(want) and len(got) > 200


def test_only_named_references_with_a_semicolon():
    page = '<h1>a &amp b &amp; &lt;c&gt &eacute; &#65;</h1><a href="/x?a=1&amp;b=2">&quot;&amp;lt;</a><title>cut&amp</title>'
    found = dom.selected(page, frozenset({"h1", "a", "title"}), None, ("lt", "gt", "quot", "amp"))
    assert found == [("h1", {}, "a &amp b & <c&gt &eacute; &#65;"), ("a", {"href": "/x?a=1&amp;b=2"}, '"&lt;'), ("title", {}, "cut&amp")]
    assert dom.selected(page, frozenset({"title"}), None) == [("title", {}, "cut&")]


def test_page_links_of_cut_references_equal_their_sql(spark, tmp_path):
    import duckdb

    from ledgerloom.plans import queries as plans

    spark.createDataFrame([(1, "u", "<title>ver &amp</title><h1>x &amp; y</h1><a href=\"\">e</a><a href=\"/a?b&amp;c\">f</a>"), (2, "u", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    names = ["page_id", "place", "tag", "href", "text"]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.sql(plans.SQL["page_links"]).select(*names).fetchall()
    got = [tuple(r) for r in plans.QUERIES["page_links"](spark, str(tmp_path)).select(*names).collect()]
    assert sorted(got) == sorted(want) and len(got) == 4
