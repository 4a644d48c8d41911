import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from loomgraph.llm.html_text import extract, visible_text


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>One<p>Two <b>bold</b>\n text", "One\n\nTwo bold text"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=9><li>x<li>y<li value=20>z</ol>", "9. x\n10. y\n20. z"),
        ("<ol type=i><li>x<li>y</ol><ol type=A><li>x</ol>", "i. x\nii. y\n\nA. x"),
        ("<table><tr><th>Name<th>N<tr><td>apple<td>1<tr><td>fig<td>22</table>", "Name   N\napple  1\nfig    22"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell<td>z</table>", "a  b\n   c\nwide cell  z"),
        ("<head><title>t</title><style>.x{display:none}</style></head><body>a<span class=x>b</span><i hidden>c</i><script>d()</script>e", "ae"),
        ("<div style='display: none'>no</div><div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
        ("<pre>\n a\n   b\n\nc</pre>d", " a\n   b\n\nc\n\nd"),
        ("a<br>b<hr>c", "a\nb\n\n---\n\nc"),
        ("x &amp; y &lt;z&gt; &eacute;&#233; &copy", "x & y <z> éé ©"),
        ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n    d1\n    d2"),
        ("<blockquote><p>q<p>r</blockquote>", "    q\n\n    r"),
        ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
        ("<b><p>one</b> two</p>three", "one two\n\nthree"),
        ("<div>a<div>b</div></div>c", "a\nb\nc"),
        ("1 < 2 <3 <!-- c > --> d <a title='>'>e</a>", "1 < 2 <3 d e"),
        ("<p>  lots \n of   blanks </p>", "lots of blanks"),
        ("", ""), (None, ""), ("<p></p>", ""), ("<", "<"), ("a<b", "a"), ("<script>never closed", ""), ("<!-- open", ""),
        ("<select><option>a<option>b</select>x<textarea>typed</textarea>", "a xtyped"),
        ("<select multiple><optgroup><option>a<option>b</optgroup></select>", "a b"), ("<select><option>a<option selected>b<option>c</select>!", "b !"),
        ("<svg><title>no</title><defs><text>no</text></defs><g>no<text>one</text></g><text>two <tspan>three</tspan></text></svg>", "one two three"),
        ("<math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math>", "x+1"), ("<object>fallback</object>", "fallback"), ("<video>no</video>", ""),
        ("<input value=name><input type=hidden value=no><input type=submit value=Go>", "name Go"),
        ("<table><tr><td colspan=300>a<td>b<tr><td>c</table>", "a  b\nc"), ("<ul><li><ul><li>x</ul></ul>", "- - x"), ("<ul><li><blockquote>q<p>r</blockquote><li></ul>", "-     q\n\n      r"),
        ("<td>loose</td>", "loose"),
    ],
)
def test_layout(html, want):
    assert extract(html) == want


class Plain(HTMLParser):
    """All text outside of unseen elements, for well-formed pages."""

    def __init__(self):
        super().__init__()
        self.off, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.off:
            self.parts.append(data)


def test_no_text_is_lost_or_invented():
    r = random.Random(7)
    tags = ["p", "div", "b", "i", "ul", "li", "ol", "table", "tr", "td", "h1", "span", "blockquote", "section", "dl", "dd", "pre"]
    for k in range(500):
        open_, out = [], []
        for j in range(r.randrange(60)):
            x = r.random()
            if x < 0.4:
                open_.append(r.choice(tags))
                out.append(f"<{open_[-1]}>")
            elif x < 0.6 and open_:
                out.append(f"</{open_.pop()}>")
            else:
                out.append(f"w{k}x{j} ")
        html = "".join(out)
        parser = Plain()
        parser.feed(html)
        want = sorted(re.findall(r"w\d+x\d+", "".join(parser.parts)))
        assert sorted(re.findall(r"w\d+x\d+", extract(html))) == want, html


def test_odd_markup_takes_linear_time():
    began = time.time()
    for html in ("<div>" * 100_000 + "x", "<a '" * 50_000, "<a \">" * 50_000, "<" * 200_000, "</p>" * 50_000, "<p>" * 50_000, "&amp" * 50_000, "<td>" * 3000, "<!--" * 50_000, "<script>" * 20_000, "<ul><li>" * 3000, "<b>x" * 20_000, "x" * 1_000_000):
        extract(html)
    assert time.time() - began < 60


def test_pages(spark):
    rows = [(1, "<p>a"), (2, None), (2, None), (None, ""), (3, "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = visible_text(pages).collect()
    assert len(got) == 5 and next(r["text"] for r in got if r["page_id"] == 1) == "a"
    assert visible_text(pages.limit(0)).collect() == []


def test_deep_nesting_keeps_attributes_and_text():
    for n in (10, 250, 30_000):
        assert extract("<div>" * n + "<div hidden>secret</div>seen" + "</div>" * n + "after") == "seen\nafter"
        assert extract("<b>" * n + "x" + "</b>" * n + "y") == "xy"
    deep = extract("<blockquote>" * 3000 + "x")
    assert deep.strip() == "x" and len(deep) == 4 * 20 + 1
    assert extract("<table><tr><td>" * 500 + "x") == "x"


def test_output_grows_with_the_page():
    rows = "".join(f"<tr><td>{i}<td>n{i}" for i in range(500))
    page = f"<table><tr><td>{'long ' * 4000}<td>end{rows}</table>"
    text = extract(page)
    assert len(text) < 2 * len(page) and text.split("\n")[0].endswith("long  end") and text.split("\n")[2] == f"1{' ' * 61}n1"
    wide = extract("<table>" + "<tr>" + "".join(f"<td>{'w' * 59}" for _ in range(50)) + "<tr><td colspan=49>a<td>b" * 300 + "</table>")
    assert len(wide) < 300 * 405 + 50 * 62 + 10 and wide.count("b") == 300
    held = extract("<table>" + "<tr><td rowspan=65534 colspan=1000>x" * 300 + "<tr><td>z</table>")
    assert held.count("x") == 300 and len(held.split("\n")[-1]) <= 401


def test_visible_words_equal_a_plain_walk():
    """Visibility from a second, plain implementation: random trees written out with all end tags."""
    r = random.Random(8)
    count = iter(range(10**6))

    def tree(depth, shown):
        """(html, visible words)"""
        html, words = [], []
        for _ in range(r.randrange(1, 4)):
            kind = r.random()
            if depth == 0 or kind < 0.3:
                w = f"w{next(count)}"
                html.append(f" {w} ")
                words += [w] if shown else []
                continue
            tag = r.choice(["div", "span", "b", "section", "blockquote", "em", "article"])
            how = r.choice(["", "", "", " hidden", ' style="display:none"', " class=gone", " id='away'", ' class="x y"'])
            inner, seen = tree(depth - 1, shown and how not in (" hidden", ' style="display:none"', " class=gone", " id='away'"))
            html.append(f"<{tag}{how}>{inner}</{tag}>")
            words += seen
            if r.random() < 0.2:
                html.append(r.choice(["<script>no()</script>", "<!-- no -->", "<template>no</template>", "<noscript>no</noscript>"]))
        return "".join(html), words

    for _ in range(200):
        html, words = tree(6, True)
        assert extract(f"<style>.gone, #away {{display: none}}</style>{html}").split() == words


@pytest.mark.parametrize(
    ("page", "seen"),
    [
        ("<style>@media print{.np{display:none}}</style><p class=np>yes</p>", "yes"),
        ("<style media=print>.np{display:none}</style><p class=np>yes</p>", "yes"),
        ("<style media='screen and (min-width: 30em)'>.np{display:none}</style><p class=np>no</p>yes", "yes"),
        ("<style>@media (max-width:600px){nav{display:none}} @media only screen and (min-width:600px){.small{display:none}}</style><nav>yes</nav><b class=small>no</b>", "yes"),
        ("<style>@media not print{.a{display:none}} @media (hover: hover){.b{display:none}} @media print, screen{.c{display:none}}</style><i class=a>no</i><i class=b>yes</i><i class=c>no</i>", "yes"),
        ("<style>.a{display:none} .a{display:block}</style><p class=a>yes</p>", "yes"),
        ("<style>.a{display:block} .a{color:red} .a{display:none}</style><p class=a>no</p>yes", "yes"),
        ("<style>.a{display:none!important} .a{display:block}</style><p class=a style='display:block'>no</p>yes", "yes"),
        ("<style>#k{display:block} .a{display:none} p{display:none}</style><p class=a id=k>yes</p><p>no</p>", "yes"),
        ("<style>.a{display:none}</style><p class=a style='display: inline'>yes</p><p hidden style='display:block'>too</p>", "yes\n\ntoo"),
        ("<style>/* .a{display:none} */ .b::before{content:'}'} @supports (display: grid){.c{display:none}} @keyframes x{.d{display:none}}</style><i class=a>a</i><i class=b>b</i><i class=c>c</i><i class=d>d</i>", "abd"),
        ("<p style='xdisplay:none'>a</p><p style=\"font-family:'display:none; display:none'\">b</p><p style='backface-visibility:hidden'>c</p><p style='color:red;display:none'>d</p>", "a\n\nb\n\nc"),
        ("<style>.a{display:none</style><style>@media {.b{display:none}</style><style>}}{;</style><i class=a>a</i><i class=b>b</i>", "a"),
    ],
)
def test_style_rules_for_the_screen(page, seen):
    assert extract(page) == seen


def test_style_sheets_take_linear_time():
    times = []
    for n in (4000, 16000):
        css = "".join(f"@media (min-width:{i}px){{.c{i}{{display:none}}}}" for i in range(n)) + "{" * n + "/*" * n + "a{" * n
        start = time.perf_counter()
        extract(f"<style>{css}</style><p style='{';' * n}display:none'>x</p>y")
        times.append(time.perf_counter() - start)
    assert times[1] < 12 * times[0]
