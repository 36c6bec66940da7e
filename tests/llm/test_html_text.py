"""Visible text of HTML pages: nothing visible is lost, nothing hidden is shown, layout is kept."""

import re
from collections import Counter

import pytest
from binomia.llm.html_text import TreeBuilder, html_text, own_text, prune, rendered, styles

CASES = {
    "text in a table moves before it": ("<table>loose<tr><td>a</table>", ["loose", "", "a"]),
    "a block in a table": ("<table><div>div text</div><tr><td>a</table>", ["div text", "", "a"]),
    "text in a row": ("<table><tr>stray<td>a<td>b</table>", ["stray", "", "a  b"]),
    "a form in a row": ("<table><tr><form><td>x<td>y</form></table>after", ["x  y", "", "after"]),
    "a row ends an open block": ("<table><div>d<tr><td>a<tr><td>b</table>", ["d", "", "a", "b"]),
    "a table directly in a table": ("<table><tr><table><tr><td>x</table>y", ["x", "", "y"]),
    "paragraphs and lists in a cell": (
        "<table><tr><td><p>para one<p>para two<ul><li>x<li>y</ul><td>z</table>",
        ["para one  z", "", "para two", "", "- x", "- y"],
    ),
    "rowspan": ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", ["a  b", "   c", "d  e"]),
    "rowspan 0 ends with its section": ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", ["a  b", "   c", "d"]),
    "colspan": ("<table><tr><td colspan=2>a long title<tr><td>b<td>c</table>", ["a long title", "b  c"]),
    "alt in a cell": ("<table><tr><td><img alt=pic><td>t</table>", ["pic  t"]),
    "nested tables": ("<table><tr><td><table><tr><td>a<td>b<tr><td>c<td>d</table><td>z</table>", ["a  b  z", "c  d"]),
    "a cell outside a table": ("<td>a</td> b", ["a b"]),
    "foreign elements close themselves": ("<svg/>after", ["after"]),
    "text of a drawing": ("<svg><defs><text>no</text></defs><title>no</title><text>seen</text></svg>x", ["seen", "x"]),
    "a block ends a drawing": ("<svg><circle><p>out</svg>", ["out"]),
    "formulas": ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", ["x=1"]),
    "visible in a hidden parent": ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", ["yes"]),
    "inline styles win": ("<style>.a{display:none} #b{visibility:hidden}</style><p class=a style='display:block'>yes<p id=b>no", ["yes"]),
    "important wins": ("<style>p{display:none !important}</style><p style='display:block'>no</p>yes", ["yes"]),
    "alt of hidden images": ("<div style='visibility:hidden'><img alt=no></div>yes", ["yes"]),
    "aria-hidden is visible": ("<i aria-hidden=true>seen</i>", ["seen"]),
    "text areas and options": (
        "<textarea>one\n two</textarea><select><optgroup label=G><option>p<option>q</select>",
        ["one", " two", "G", "p", "q"],
    ),
    "values of inputs": ("<input type=submit value=Go><input type=hidden value=no><input type=checkbox value=no>", ["Go"]),
    "closed dialogs": ("<dialog>no</dialog><dialog open>yes</dialog>", ["yes"]),
    "a head without an end": ("<head><meta charset=x>text", ["text"]),
}


@pytest.mark.parametrize("name", CASES)
def test_visible_text(name):
    html, lines = CASES[name]
    assert rendered(html).split("\n") == lines


def walked(html: str) -> str:
    """All visible characters, in the order of the tree."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    prune(builder.root, styles(builder.css))
    out, work = [], [builder.root]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            out.append(own_text(item))
            work += reversed(item.children)
    return "".join(out)


def signs(text: str) -> Counter:
    """Characters without white space and those of which marks of lists and rules consist."""
    return Counter(re.sub(r"[\s\-.0-9]", "", text))


def test_no_visible_character_of_the_pages_is_lost(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    assert rows
    for row in rows:
        assert row.html is None or signs(walked(row.html)) == signs(rendered(row.html)), row.page_id
    for html, _ in CASES.values():
        assert signs(walked(html)) == signs(rendered(html))


def test_long_and_deep_pages(spark):
    nested = "<table><tr><td>" * 400 + "core" + "</table>" * 400
    long = "<p>" + "word " * 400_000 + "<table>" + "<tr><td>a<td>b" * 20_000 + "</table>"
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame([(1, nested), (2, long)], "page_id long, html string")).collect()}
    assert got[1] == "core" and got[2].count("word") == 400_000 and got[2].count("a  b") == 20_000


def test_wide_cells_do_not_widen_every_row():
    page = "<table><tr><td>" + "x" * 100_000 + "<td>end" + "<tr><td>a<td>b" * 1000 + "</table>"
    assert len(rendered(page)) < 400_000 and "xx  end" in rendered(page)


def test_an_empty_table_gives_an_empty_one(spark):
    assert html_text(spark.createDataFrame([], "page_id long, html string")).collect() == []
