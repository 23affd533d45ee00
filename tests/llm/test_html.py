import random
from html.parser import HTMLParser

import pytest

from leafgate.llm.htmltext import DEEPEST, extracted, render


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><th>n<th>long cell<tr><td colspan=2>wide<tr><td>aaaa<td>z</table>", "n     long cell\nwide\naaaa  z"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("a<script>var x='<p>';</script>b<style>p{}</style><!-- no -->c", "abc"),
        ("<p hidden>a</p><p style='display: none'>b</p><span style='visibility:hidden'>c</span>d<template>e</template>", "d"),
        ("<details><summary>s</summary>gone</details><details open><summary>t</summary>here</details>", "s\nt\nhere"),
        ("<pre>\n a\n\n  b</pre>", " a\n\n  b"),
        ("1 < 2 &amp; 3&nbsp;4 &lt;b&gt;", "1 < 2 & 3 4 <b>"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<b><p>a</b>b</i></p>c", "ab\n\nc"),
        ("x<!-- open", "x"),
        ("x<a href='open", "x"),
        ("<title>t</title><body>b", "b"),
        ("<select><option>one<option>two</select>", "one\ntwo"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"),
        ("<" * 50, "<" * 50),
    ],
)
def test_render(page, text):
    assert render(page)[1] == text


def test_deep_and_long_pages():
    assert render("<div>" * 20000 + "x")[1] == "x"
    assert len(render("<p>word " * 50000)[1].split()) == 50000
    assert render("<table><tr>" + "<td>x" * 300)[1].split() == ["x"] * 300


def test_rows(spark):
    rows = [(1, "<title> a\nb </title><ul><li>x</ul><table><tr><td>y</table>", "u"), (2, None, None), (2, None, None), (None, "z", "w")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r["page_id"] or 0), r["title"], r["text"], r["n_lines"], r["n_items"], r["n_tables"]) for r in extracted(pages).collect())
    assert got == [(0, "", "z", 1, 0, 0), (1, "a b", "- x\n\ny", 3, 1, 1), (2, "", "", 0, 0, 0), (2, "", "", 0, 0, 0)]
    assert extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<a href=it's>b</a>c</p> tail", "abc\n\ntail"),
        ('<p>x<a class="a"b">y</a> rest "q" end', 'xy rest "q" end'),
        ("<p class=o'brien>hello</p> x", "hello\n\nx"),
        ('<img alt="5" tall">text', "5text"),
        ("<a title=don't href=x>a</a> it's fine <b>z", "a it's fine z"),
        ('<p title="x>open</p> and <b>more</b>', "open\n\nand more"),
        ("<a\nhref = 'q>r' b=c>k</a>", "k"),
        ("<a href=>e</a><a =x>f</a>", "ef"),
        ("x < y <b", "x < y"),
        ('<div style="visibility:hidden">no<p style="visibility:visible">yes</p>no</div>', "yes"),
        ('<ul style="visibility: collapse"><li>no</ul><p>yes', "yes"),
        ('<div style="display:none">no<p style="visibility:visible">no</p></div>yes', "yes"),
        ("<svg><title>t</title><desc>d</desc><text>label</text></svg><math><mi>x</mi><annotation>a</annotation></math>", "labelx"),
    ],
)
def test_tags_are_read_as_html_says(page, text):
    assert render(page)[1] == text


def test_elements_beyond_the_deepest_keep_their_order_hiding_and_ends():
    inner = "deep<span hidden>no<b>no</b></span> er<p>par</div>two"
    page = "<div>" * (DEEPEST + 250) + inner + "</div>" * (DEEPEST + 250) + "out"
    assert render(page)[1] == "deep er\npar\ntwo\nout"
    assert render("<div>" * 50_000 + "x" + "</div>" * 50_000 + "y")[1] == "x\ny"
    assert render("<li>" * 1000 + "k")[2] == 1000


def test_visible_words_are_those_of_the_standard_librarys_tokeniser():
    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.said = []

        def handle_data(self, data):
            self.said.append(data)

    rng = random.Random(4)
    value = lambda: rng.choice(['"a b"', "'c>d'", "it's", 'x"y', "", "z", "'\"'", '"\'"'])
    tag = lambda: rng.choice(["b", "i", "span", "p", "div", "li", "td", "em"])
    for _ in range(2000):
        page = ""
        for k in range(rng.randint(1, 12)):
            attributes = "".join(f" {rng.choice(['class', 'href', 'x'])}{rng.choice(['=', ' = '])}{value() or 'v'}" for _ in range(rng.randint(0, 3)))
            page += rng.choice([f"w{k} ", f"<{tag()}{attributes}>", f"</{tag()}>", f"w{k}&amp;\n"])
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert "".join(render(page)[1].replace("-", "").split()) == "".join("".join(plain.said).split()), page


@pytest.mark.parametrize("depth", [2, 160, 400, 500])
def test_elements_above_the_deepest_are_laid_out_alike(depth):
    inner = "deep<p>par</p><p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p><details><summary>s</summary>no</details>"
    assert render("<div>" * depth + inner + "</div>" * depth + "out")[1] == "deep\n\npar\n\nyes\n\ns\nout"
    assert render("<table><tr><td>" * 120 + "x" + "</table>" * 120)[1] == "x"
    assert render("<ul><li>" * (DEEPEST // 2 - 5) + "x")[1].split() == ["-"] * (DEEPEST // 2 - 5) + ["x"]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tbody><form><tr><td>in form</td></tr></form></tbody></table>", "in form"),
        ("<form>a<table><tr><td>b</td></tr></form></table>c", "a\n\nb\n\nc"),
        ("<table><tbody><td>cell without row</td></tbody></table>", "cell without row"),
        ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<table><thead><th>H1<th>H2<tbody><tr><td>a<td>b</table>", "H1  H2\na   b"),
        ("<table><tr><td>t</td></tr><tbody>loose <b>bold</b><div>d</div><tr>x<td>c</table>", "loose bold\nd\nx\nt\nc"),
        ("<table><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>", "h\nb\nf"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"),
        ("<table><tr><td rowspan=70000>a<td>b" + "<tr><td>c" * 1200 + "</table>", "a  b" + "\n   c" * 1200),
        ("<pre>a<div>b</div>c\n<p>d</p></pre>", "a\nb\nc\nd"),
        ("<ol reversed type=i><li>a<li value=9>b<li>c</ol>", "iii. a\nix. b\nviii. c"),
        ("<ol type=A start=26><li>y<li>z<li type=1>w</ol>", "Z. y\nAA. z\n28. w"),
        ("<ol type=I start=3999><li>a<li>b</ol><ol type=a start=0><li>c</ol>", "MMMCMXCIX. a\n4000. b\n\n0. c"),
        ("<input type=email value=e> <input type=password value=p><input type=image alt=i> <input value=v><input type=hidden value=h>", "e i v"),
    ],
)
def test_malformed_tables_lists_and_inputs(page, text):
    assert render(page)[1] == text


def test_random_tables_keep_their_rows():
    rng = random.Random(6)

    def table(depth: int) -> tuple[str, list[list[str]], list[str]]:
        """A page's table, the words of its rows, and those that stand between its cells."""
        out, rows, loose, n = "<table>", [], [], rng.randint(0, 10**6)
        closed = True  # whether the row before has an end
        for g in range(rng.randint(1, 3)):
            if g or rng.random() < 0.5:
                out += "<tbody>"
                closed = True
            for r in range(rng.randint(1, 3)):
                if closed and rng.random() < 0.3:
                    loose.append(f"l{n}x{g}x{r}")
                    out += rng.choice([f" {loose[-1]} ", f"<i> {loose[-1]} </i>", f"<form> {loose[-1]} "])
                out += "" if closed and rng.random() < 0.4 else "<tr>"
                row = []
                for c in range(rng.randint(1, 4)):
                    said, words = f"w{n}x{g}x{r}x{c}", [f"w{n}x{g}x{r}x{c}"]
                    if depth and rng.random() < 0.3:
                        inner, its, between = table(depth - 1)
                        said, words = inner, [*between, *(w for x in its for w in x)]
                    out += f"<td>{said}" if rng.random() < 0.5 else f"<th>{said}</th>"
                    row += words
                rows.append(row)
                closed = rng.random() < 0.5
                out += "</td></tr>" if closed else ""
        return out + "</table>", rows, loose

    for _ in range(1500):
        page, rows, loose = table(0)
        lines = [x.split() for x in render(page)[1].split("\n")]
        assert lines == ([loose] if loose else []) + rows, page
        page, rows, loose = table(2)
        assert sorted(render(page)[1].split()) == sorted(loose + [w for x in rows for w in x]), page
