import re
import time

import pytest

from tagweave.llm.html_text import extract_text, render

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<b>x</b> <i>y</i>z": "x yz",
    " a \n\t b ": "a b",
    "<ul><li>one<li>two<ul><li>in</ul><li>three</ul>": "* one\n* two\n  * in\n* three",
    "<ol start=3><li>a</li><li>b</li></ol>": "3. a\n4. b",
    "<h1>T</h1>text<script>if (a<b) {}</script> more<!-- c > d -->": "T\n\ntext more",
    "<head><title>no</title></head><body>yes": "yes",
    "<title>no<p>still</title>yes": "yes",
    "<p hidden>a</p><p style='display : none'>b</p><p style=visibility:hidden>c</p>d": "d",
    "<div title='a > b'>x</div>": "x",
    "&lt;a&gt; &amp; &eacute;&#233;&nbsp;x": "<a> & éé\xa0x",
    "<pre> a\n  b </pre>c": " a\n  b \n\nc",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>": "Name       N\nlong name  1\nb          22",
    "<table><tr><td colspan=2>wide</td></tr><tr><td>a</td><td>b</td></tr></table>": "wide\na     b",
    "x<table><caption>C</caption><tbody><tr><td>1</td></tr></tbody></table>y": "x\n\nC\n1\n\ny",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<select><option>a</select>b<template>c</template>": "b",
    "<p>a<div>b</div>c</p>d": "a\n\nb\nc\n\nd",
    "a</p>b": "a\n\nb",
    "<td>x</td>": "x",
    "1 < 2 and <3": "1 < 2 and <3",
    "<a href='x": "",
    "<noscript>n</noscript>t": "t",
    "<blockquote>q<p>r</blockquote>": "  q\n\n  r",
    "<table><tr><td>漢字<td>x<tr><td>ab<td>y</table>": "漢字  x\nab    y",
    "<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>": "a\n\ni  j  b",
    "<table><tr><td rowspan=2>A<td>1<tr><td>2</table>": "A  1\n   2",
    "<table><tr><td>x<td rowspan=3>R<td>y<tr><td>p<td>q<tr><td colspan=1>s<td>t<tr><td>u<td>v<td>w</table>": "x  R  y\np     q\ns     t\nu  v  w",
    "<table><tr><td>one<br>two<td>b<tr><td>c<td>d</table>": "one\ntwo  b\nc    d",
    "<table><tr><td>a<td>x<br>y<td>z<tr><td>long<td>m<td>n</table>": "a     x\n      y  z\nlong  m  n",
    "<details><summary>s</summary>no<p>no</p></details>t": "s\nt",
    "<details open><summary>s</summary>yes</details>t": "s\nyes\nt",
    "<details><b>no</b><summary>s<i>u</i></summary></details><div hidden><details><summary>no</summary></details></div>t": "su\nt",
    "<details data-open=1>no<details open><summary>no</summary></details></details>t": "t",
    "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>t": "yes\nt",
    "<p style='visibility:collapse'>no<p>yes": "yes",
    "<div style='display:none'><b style='visibility:visible'>no</b></div>t": "t",
    "<table><tr><td rowspan=0>a<td colspan=0>b<tr><td>c<td>d</table>": "a  b\nc  d",
    "<!DOCTYPE html><?xml x?><p>z": "z",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert render(page).rstrip() == CASES[page].rstrip()


def test_deep_and_broken_pages():
    assert render("<div>" * 20000 + "x") == "x"
    assert render("<ul><li>" * 300 + "x").endswith("x")
    assert render("<p>" + "a<" * 20000) == "a"  # a tag that never ends is dropped
    assert render("<a title=\"" * 3000 + "x") == ""
    assert render("</" * 5000 + "x") is not None


def test_all_visible_text_is_kept(spark, sf01):
    """Words of the text nodes outside hidden elements all appear, in order, as html.parser sees them."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("head", "script", "style")

        def handle_endtag(self, tag):
            self.off -= tag in ("head", "script", "style")

        def handle_data(self, data):
            if not self.off:
                self.words += data.split()

    pages = spark.read.parquet(f"{sf01}/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    n = 0
    for r in pages.collect():
        p = Plain()
        p.feed(r.html or "")
        p.close()
        text = got[r.page_id].text
        plain = re.sub(r"^ *(\*|\d+\.) ", "", text, flags=re.M)
        assert plain.split() == p.words, r.page_id
        assert got[r.page_id].n_chars == len(text)
        n += 1
    assert n == len(got)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "<p>a", "x"), (1, None, "x")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in got) == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_tables_stay_in_proportion():
    """A long first cell doesn't pad all others; no text is lost and the order stays."""
    cells = [f"c{i}" for i in range(60_000)]
    for first in ("long " * 20_000, "x" * 79):
        page = "<table><tr><td>" + first + "<td>z" + "".join(f"<tr><td>{c}<td>{c}b" for c in cells) + "</table>"
        text = render(page)
        assert len(text) < 4 * len(page)
        assert text.split() == [*first.split(), "z", *(w for c in cells for w in (c, c + "b"))]


def columns_of(rows):
    """Where each column begins by plain sums, for one-line cells without spans."""
    n = max(map(len, rows))
    wide = [max((len(r[k]) for r in rows if k < len(r) and len(r[k]) <= 80), default=0) for k in range(n)]
    return [sum(w + 2 for w in wide[:k]) for k in range(n)]


def test_cells_are_aligned():
    """Every cell begins at its column; one that is too long moves only the rest of its row, and no size switches this off."""
    import random

    r = random.Random(3)
    for n_rows, long in ((1, False), (5, False), (40, True), (3000, True)):
        rows = [["".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 5))] for _ in range(n_rows)]
        if long:
            rows[n_rows // 2] = ["q" * 5000, "z"]
        begin = columns_of(rows)
        lines = render("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in rows) + "</table>").rstrip("\n").split("\n")
        assert len(lines) == n_rows
        for row, line in zip(rows, lines):
            if len(row[0]) < 81:
                assert all(line[b : b + len(c)] == c and line[b - 2 : b].strip() == "" for b, c in zip(begin, row))
            else:
                assert line == row[0] + "  z"


def test_space_grows_with_the_page():
    for make in (
        lambda n: "<ul><li>x" * n,
        lambda n: "<blockquote>x" * n,
        lambda n: "<table><tr><td>x" * n,
        lambda n: "<table>" + "<tr><td rowspan=99999>x" * n,
        lambda n: "<table>" + "<tr><td colspan=900><td>x" * n,
    ):
        small, large = len(render(make(1000))), len(render(make(4000)))
        assert large < 5 * small + 1000


def test_time_grows_with_the_page():
    def took(page):
        began = time.process_time()
        render(page)
        return time.process_time() - began

    for make in (
        lambda n: "<i>" * n + "</b>" * n,
        lambda n: "<b><table><td>" + "<i>" * n + "</b>" * n,
        lambda n: "<i>" * n + "<h1></h1>" * n,
        lambda n: "<table>" + "<tr><td rowspan=99>a<td>b" * n,
        lambda n: "<table>" + "<tr><td rowspan=99999>x" * (n // 2),
        lambda n: "<table><tr><td>x" * (n // 8),
        lambda n: "<ul><li>x" * (n // 4),
    ):
        small, large = took(make(4000)), took(make(16000))
        assert large < 12 * small + 0.5
