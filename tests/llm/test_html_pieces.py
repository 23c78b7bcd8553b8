"""Pieces of HTML that pages hold now and then."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.llm import html_text
from vacantia.llm.html_text import visible_text

PIECES = "<![foo[x]]> <![ <![if !IE]> <![endif]> <![CDATA[ ]]> <![foo[ <!x <!doctype <? </ > <p> </p> <table> <td> word <!-- --> <svg> </svg> <text> <text/> <math> <mi> </math> <foreignObject> <annotation> <li> </li> <tr> <title>".split()


@pytest.mark.parametrize("html, text", [
    ("a<![foo[x]]>b", "ab"), ("a<![ if]>b", "ab"), ("a<![if !IE]>b<![endif]>c", "abc"), ("a<![", "a"), ("a<![x", "a"),
    ("<p>a<![CDATA[b>c", "ac"), ("<!--[if IE]>x<![endif]-->y", "y")])
def test_marked_sections_are_comments(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then", "if x=2 then"),
    ("<math><semantics><mi>y</mi><annotation>tex</annotation><annotation-xml>z</annotation-xml></semantics></math>", "y"),
    ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "1 2"),
    ("<svg><title>t</title><desc>d</desc><defs><text>u</text></defs><style>.a{}</style>raw<g><text>A <tspan>B</tspan></text></g></svg>", "A B"),
    ("a<svg><path d='x'/><defs/><text>L</text><text>M</text></svg>b", "a\nL\nM\nb"),
    ("a<svg/>b<p>c", "ab\n\nc"), ("<svg><path><p>out", "out"), ("<svg><defs>x</defs><foreignObject><div>in</div></foreignObject></svg>", "in"),
    ("<svg><text><![CDATA[a>b]]></text></svg>c", "a>b\nc"), ("<svg><text display='none'>n</text></svg>m", "m"),
    ("<table><tr><td><svg><text>A</text></svg><td>b</table>", "A  b"), ("<text>t</text><desc>d</desc>", "td"),
    ("<svg><g hidden><text>h</text></g></svg>", "h"),
    ("<a><svg><a><text>l</text></a></svg></a> k", "l\nk")])
def test_formulas_and_labels_are_shown(html, text):
    assert html_text.visible_text(html) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25), st.sampled_from(["", " "]))
def test_any_declaration_is_read(parts, between):
    html_text.visible_text(between.join(parts))


@pytest.mark.parametrize("piece", ["<a x=", "<!--x", "<!", "</", '<a "', "&#", "<a x='", "<?x", "<![x", "</b "])
@pytest.mark.parametrize("tail", ["", ">"])
def test_a_page_of_unfinished_markup_ends_soon(piece, tail):
    began = time.process_time()
    visible_text("hello " + piece * (1_000_000 // len(piece)) + tail)
    assert time.process_time() - began < 10


@pytest.mark.parametrize("html,text", [
    ("hello <!-- never closed <b>x</b>", "hello"), ('hello <a href="x', "hello"), ("hello <!DOCTYPE", "hello"), ("hello <?php x", "hello"),
    ("hello </b", "hello"), ("a < b", "a < b"), ("a </", "a </"), ("x<script>a='<!--'</script>y", "xy"), ("<p>1<!-- c -->2", "12")])
def test_what_is_never_closed_runs_to_the_end(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b    c\nd       e"),
    ("<table><tr><td rowspan=x>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<ol reversed start=9><li>a<li>b</ol>", "9. a\n8. b"), ("<ul><li value=3>a</ul>", "- a"),
    ('<p style="display:none;display:block">a', "a"), ('<p style="display:block;display:none">a', ""),
    ('a<b style="visibility:hidden;visibility:visible">b</b>', "ab"), ('a<b style="visibility:collapse">b</b>', "a")])
def test_cells_lists_and_declarations(html, text):
    assert visible_text(html) == text
