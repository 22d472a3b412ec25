"""Rendered pages: layout as written by hand, visibility, open quotes, and output in proportion to the page."""

import re

import pytest

from tessera.llm.html import DEEPEST, WIDEST, text_of


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>one <a href="x>two</a> three</p><p>four</p>', "one two three\n\nfour"),
        ("<p>one <a title='x>two</a> three", "one two three"),
        ("<p>it's <b class=a'b>bold</b> isn't it</p>", "it's bold isn't it"),
        ('<p>a <img alt="1 > 0">b <a href = "x>y">c</a>', "a b c"),
        ('<p>a<b title="never closed', "a"),
        ("1 < 2 <3", "1 < 2 <3"),
    ],
)
def test_quotes_of_tags(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div style="visibility:hidden">a<b style="visibility:visible">b</b>c</div>d', "b\nd"),
        ('<div style="visibility:hidden">a<i style="visibility:inherit">b</i></div>', ""),
        ('<div style="visibility:hidden"><div style="display:none"><b style="visibility:visible">b</b></div></div>', ""),
        ('<p style="display:none; DISPLAY : block">a<p style="color:red;display:none">b', "a"),
        ('<ol><li>a<li style="visibility:hidden">b<li>c</ol>', "1. a\n3. c"),
        ('<ul><li style="visibility:collapse">b<u style="visibility:visible">u</u></ul>', "u"),
        ('<table><tr><td>a<td style="visibility:hidden">bbbb<td>c<tr style="visibility:hidden"><td>x<td style="visibility:visible">y</table>', "a     c\n   y"),
        ('<body hidden><p>a', ""),
        ('<body style="visibility:hidden"><p>a<p style="visibility:visible">b', "b"),
    ],
)
def test_visibility_is_inherited_and_undone(page, want):
    lines = lambda text: [" ".join(x.split()) for x in text.split("\n")]  # noqa: E731  hidden cells widen no column
    assert lines(text_of(page)) == lines(want)


def test_layout_of_a_whole_page():
    page = """<html><head><title>no</title></head><body><h1>Title</h1>lead <b>bold</b><p>para<br>next
    <ul><li>one<li>two<p>more</ul><dl><dt>term<dd>said</dl><pre>a  b
  c</pre><table><caption>cap</caption><tr><th>name<th>n<tr><td>longer name<td>10</table><blockquote>q<hr>r</blockquote>end"""
    want = "Title\n\nlead bold\n\npara\nnext\n\n- one\n- two\n\n  more\n\nterm\n  said\n\na  b\n  c\n\ncap\nname         n\nlonger name  10\n\n  q\n\n  r\n\nend"
    assert text_of(page) == want


def test_long_cells_do_not_widen_a_column():
    long, fits = "x" * (WIDEST + 1), "y" * WIDEST
    assert text_of(f"<table><tr><td>{long}<td>b<tr><td>aaa<td>b<tr><td>a<td>b</table>") == f"{long}  b\naaa  b\na    b"
    assert text_of(f"<table><tr><td>{fits}<td>b<tr><td>a<td>b</table>") == f"{fits}  b\na{' ' * (WIDEST + 1)}b"


@pytest.mark.parametrize("n", [1_000, 4_000])
@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<table><tr><td>" + "x" * 20 * n + "<td>b" + "<tr><td>a<td>b" * n + "</table>",
        lambda n: "<ul><li>a" * n,
        lambda n: "<blockquote>a" * n,
        lambda n: "<table><tr><td>a<td>" * n,
        lambda n: "<table><tr>" + "<td>c" * 1000 + "<tr><td>a<td colspan=998>b<td>c" * n,
        lambda n: "<table><tr>" + "<td rowspan=0>c" * 1000 + "<tr><td>b" * n,
        lambda n: "<table><tr><td>" + "a<br>" * n + "<td>" + "b<br>" * n,
    ],
)
def test_text_grows_with_the_page(page, n):
    """At most a constant times the page, with all its letters."""
    page = page(n)
    text = text_of(page)
    assert len(text) <= 40 * len(page)
    assert sorted(text.replace("-", "").split()) == sorted(re.sub("<[^>]*>", " ", page).split())


def test_items_keep_their_marks_below_the_deepest_level():
    depth = DEEPEST + 3
    lines = text_of("<ol><li>a" * depth).split("\n")
    assert [x.strip() for x in lines if x] == ["1. a"] * depth
    assert max(len(x) - len(x.lstrip()) for x in lines) == 3 * (DEEPEST - 1) + 3
