"""Broken and very long pages: parsing takes time in proportion, and loses no text."""

import time

import pytest

from foliolake.llm import html_text

LONG = {
    "unclosed quotes": "<p z='a <b " * 80_000, "unclosed quotes and a bracket": "<p z='a <b " * 80_000 + ">", "unmatched ends": "<i></b>" * 120_000, "paragraphs in inline elements": "<i>" * 100_000 + "<p>" * 100_000,
    "items behind a division": "<p><div>" + "<i>" * 100_000 + "<li>" * 100_000, "brackets in quotes": "<p '>' " * 100_000 + "'", "brackets alone": "<" * 900_000, "unclosed scripts": "<script " * 120_000, "deep": "<div>" * 90_000 + "</div>" * 90_000,
}


@pytest.mark.parametrize("name", LONG)
def test_time(name):
    """Four times the page takes no more than some four times as long; a page of 1 MB takes seconds at most on a slow machine."""
    page = LONG[name]
    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 10


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("a < b and c > d", ["a < b and c > d"]),
        ("<p title='x > y'>in</p>out", ["in", "out"]),
        ("<p title='never closed>in</p>out", ["in", "out"]),
        ("<p>one</b> two</p>", ["one two"]),
        ("<p>1 <math><mi>x</mi></math> <svg><text>y</text></svg> <object>z</object> <canvas>c</canvas></p><noscript>n</noscript>", ["1 x y z c", "n"]),
        ("<p>a<script>if (a < b) { x('<p>') }</script>b<style>p > q {}</style>c</p>", ["abc"]),
        ("<ul><li>1<li>2</ul><!-- <p>no</p> -->3", ["1", "2", "3"]),
        ("<script>unclosed", []),
        ("tail <", ["tail <"]),
        ("<p a=\"<b>\">x", ["x"]),
    ],
)
def test_texts(page, texts):
    assert [b.text for b in html_text.parse(page)[1]] == texts
