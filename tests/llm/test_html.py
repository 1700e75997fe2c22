"""Rendering of HTML against expected layouts, and edge cases."""

import random
import time

import pytest

from rubrica.llm import html_text
from rubrica.llm.html_text import visible_text


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("", ""), ("plain &amp; &lt;text&gt;", "plain & <text>"), ("a  <b>b</b>\n c", "a b c"), ("a<b> b</b>c", "a bc"), ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<html><head><title>t</title><style>p{}</style></head><body>x<script>var a='</p>'</script>y", "xy"), ("<!-- c --><![CDATA[d]]><?pi?>e", "de"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"), ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<table><tr><th>ab<th>c<tr><td>x<td>long cell</table>", "ab  c\nx   long cell"), ("<table><td>a<td>b</table>", "a  b"), ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b  c"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"), ("<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>", "a  b\n\ni  j".replace("a  b\n\ni  j", "a     b\n\ni  j")),
        ("<p hidden>x</p><p style='display: none'>y</p><p style='visibility:hidden'>z<b style='visibility:visible'>v</b></p>", "v"), ("<style>.off{display:none} #o2, em {visibility: hidden}</style><p class='a off'>x</p><p id=o2>y</p><em>z</em>w", "w"),
        ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>", "s\nt\ny"), ("<select><option>a<option selected>b</select>", "b"), ("<input type=hidden value=x><input type=submit value=Go>", "Go"),
        ("<h1>a<h2>b", "a\n\nb"), ("</div></p>a</b>", "a"), ("<div>a<table>", "a"), ("<a href='x>y'>t</a>", "t"), ("a < b and c<d", "a < b and c"), ("<blockquote>q</blockquote>", "  q"), ("<textarea> a\n b</textarea>", " a\n b"),
    ],
)
def test_layout(markup, text):
    assert visible_text(markup) == text


@pytest.mark.parametrize(
    ("sheet", "text"),
    [
        ("@media print { .n {display:none} } @media (max-width:600px){.s{display:none}}", "n s"), ("@media screen{.n{display:none}} .s{display:none;}", ""), ("@media only screen, print {.n{visibility:hidden}}", "s"),
        (".n{display:none} @media print{.n{display:block}}", "s"), ("@import url('x;{y'); .n{display:none}", "s"), (".x{color:red; .n{display:none}} .s{display:none", "n"), ("@supports (a:b){.n{display:none}} @layer q{.s{display:none}}", "n"),
        (".x::after{content:'}'} /* } */ .n{display:none}", "s"), ("@media not print{.n{display:none}} @media print and (color){.s{display:none}}", "s"),
    ],
)
def test_conditional_sheets(sheet, text):
    assert visible_text(f"<style>{sheet}</style><span class=n>n</span> <span class=s>s</span>") == text


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> ok", "so x=1 ok"), ("<svg><title>t</title><desc>d</desc><metadata>m</metadata><defs><text>no</text></defs>bare<g><text x=1>La<tspan>bel</tspan></text><text>two</text></g></svg> after", "Label two after"),
        ("<svg><path d='x'>icon<p>para", "para"), ("a<svg><path/></svg>b", "ab"), ("<svg><foreignObject><div>in</div></foreignObject></svg>", "in"), ("<style>.o{display:none}</style><svg class=o><text>x</text></svg>z", "z"), ("<svg><script>var a</script><text>v</text></svg>", "v"),
    ],
)
def test_drawings_and_formulas(markup, text):
    assert visible_text(markup) == text


@pytest.mark.parametrize("markup", ["<div>" * 50_000 + "x", "<table><tr><td>" * 3000 + "x", "<ul><li>" * 3000 + "x", "<p>" + "w " * 200_000, "<" * 5000, "<a " * 3000, "&" * 5000, "<!--" * 2000])
def test_stress(markup):
    text = visible_text(markup)
    assert "x" in text if markup.endswith("x") else text is not None


@pytest.mark.parametrize(
    "markup",
    ["<a " * 80_000 + '"', "<a b='" * 80_000 + '"', "<p><button>" + "<b>" * 80_000 + "</p>" * 80_000, "<p><button>" + "<b>" * 80_000 + "<hr>" * 80_000, "<div>" * 60_000 + "<body>" * 60_000, "<head><div>" * 40_000, "<li><ul>" * 20_000 + "</li>" * 60_000],
)
def test_parsing_is_linear(markup):
    began = time.process_time()
    html_text.parse(markup)
    assert time.process_time() - began < 4  # some tenths of a second; quadratic work takes minutes


def plain_cascade(sheet, inline, tag, classes, ident):
    """(isn't displayed, is visible) by comparing every declaration with every other."""
    ranked = []
    for place, (selector, body) in enumerate(sheet):
        weight = 2 if selector[0] == "#" else 1 if selector[0] == "." else 0
        if selector in (tag, f"#{ident}", *(f".{c}" for c in classes)):
            ranked += [(important, weight, place, i, name, value) for i, (name, value, important) in enumerate(body)]
    ranked += [(important, 3, 0, i, name, value) for i, (name, value, important) in enumerate(inline)]
    out = {"display": "inline", "visibility": "visible"}
    for *_, name, value in sorted(ranked):
        out[name] = value
    return out["display"] == "none", out["visibility"] == "visible"


def test_cascade_equals_plain():
    rng = random.Random(11)
    declaration = lambda: rng.choice([("display", rng.choice(["none", "block"])), ("visibility", rng.choice(["hidden", "visible", "collapse"]))])
    block = lambda: [(*declaration(), rng.random() < 0.25) for _ in range(rng.randrange(1, 4))]
    text = lambda body: ";".join(f"{n}:{v}{' !important' if i else ''}" for n, v, i in body)
    for _ in range(500):
        sheet = [(rng.choice(["em", ".a", ".b", "#i"]), block()) for _ in range(rng.randrange(6))]
        inline = block() if rng.random() < 0.5 else []
        classes = rng.sample(["a", "b"], rng.randrange(3))
        style = "".join(f"{selector}{{{text(body)}}}" for selector, body in sheet)
        markup = f"<style>{style}</style>x<em class='{' '.join(classes)}' id=i{f' style={chr(34)}{text(inline)}{chr(34)}' if inline else ''}>y</em>"
        gone, seen = plain_cascade(sheet, inline, "em", classes, "i")
        assert visible_text(markup) == ("xy" if seen and not gone else "x"), markup


@pytest.mark.parametrize(
    ("sheet", "markup", "text"),
    [
        (".x{display:none}.x{visibility:visible}", "<p class=x>t", ""), ("em{display:none}.y{visibility:visible}", "<em class=y>t</em>", ""), (".a{display:none!important}", "<p class=a style='display:block'>t", ""),
        ("P{display:none}", "<p>t", ""), (".h{visibility:hidden}.v{visibility:inherit}", "<div class=h>a<p class=v>b</p></div>", ""), (".a{display:none}.b{display:block}", "<p class='b a'>t", "t"),
    ],
)
def test_properties_stay_apart(sheet, markup, text):
    assert visible_text(f"<style>{sheet}</style>{markup}") == text


def test_no_visible_word_is_lost(spark):
    import re

    from tests.conftest import SMALL

    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->", " ", r.html)
        import html as lib

        want = lib.unescape(re.sub(r"<[^>]+>", " ", body)).split()
        got = [w for w in visible_text(r.html).split() if w != "-"]
        assert "".join(got) == "".join(w for w in want if w != "-")


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "<p>x", "c"), (1, "<p>x", "c")], "page_id long, html string, text string")
    got = html_text.extract_text(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in got) == [(0, "x", 1), (1, "", 0), (1, "x", 1), (2, "", 0)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "a", 1)] * 3, "page_id long, html string, text string, n_chars int")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).collect()] == [(1, "x", 1)] * 3


def test_long_spans():
    """A cell may span as many rows as the grammar allows; those below stand beside it."""
    rows = "".join(f"<tr><td>v{i}</td></tr>" for i in range(1500))
    lines = visible_text(f"<table><tr><td rowspan=2000>side</td><td>v</td></tr>{rows}</table>").splitlines()
    assert lines[0] == "side  v" and {len(x) - len(x.lstrip()) for x in lines[1:]} == {6}


def test_columns_by_plain_grid():
    """Gaps against a table of every column's first free row."""
    rng = random.Random(5)
    for _ in range(200):
        columns, free = html_text.Columns(), {}
        for row in range(rng.randint(1, 12)):
            at = 0
            for _ in range(rng.randint(0, 6)):
                span, down = rng.choice((1, 1, 2, 3, 9)), rng.choice((1, 1, 2, 3, 7))
                plain = at
                while free.get(plain, 0) > row:
                    plain += 1
                at = columns.first(at)
                assert at == plain
                if down > 1:
                    columns.take(at, at + span, down)
                    free |= {c: row + down for c in range(at, at + span) if free.get(c, 0) <= row}
                at += span
            columns.next_row()


def test_many_long_spans():
    """Cells that each span all rows below take work and blanks in proportion to the page."""
    for cell in ("<td rowspan=65534 colspan=100>x", "<td rowspan=65534>word"):
        text = visible_text("<table>" + f"<tr>{cell}" * 20_000 + "</table>")
        assert text.split() == [cell.rsplit(">", 1)[1]] * 20_000 and len(text) < 20_000 * (html_text.PADDING + 10)
