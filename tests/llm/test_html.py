"""Odd and very large pages, and layouts that the trees haven't seen."""

import time

import numpy as np
import pytest

from graphloom.llm import html


@pytest.fixture(scope="module")
def trees():
    return html.model()


def test_large_pages_take_linear_time(trees):
    body = "<article><p>Some words of the article, which go on for a while.</p></article>"
    for page in (
        "<script>a<b'</script>" * 10_000 + body,
        "<div>" * 50_000 + body,
        "<div>x" * 50_000 + "</p></li></td>" * 20_000 + body,
        "<p>one" * 50_000,
        "<li>" * 20_000 + "</ul>" * 20_000 + body,
        "<a href='" * 5_000 + body,
        "x" * 1_000_000 + "<!--" * 1_000,
        "",
    ):
        began = time.time()
        assert isinstance(html.extract([page], trees)[0], str)
        assert time.time() - began < 5


def test_unseen_layouts_keep_the_main_text_whole_and_alone(trees):
    whole = alone = 0
    held = list(html.layouts(60, seed=99))
    for page in held:
        blocks = [b for b in html.extract([page], trees)[0].split("\n\n") if b]
        whole += sum("MAIN" in b for b in blocks) >= page.count("MAIN")
        alone += bool(blocks) and all("MAIN" in b for b in blocks)
    assert whole >= 0.8 * len(held) and alone >= 0.8 * len(held)


def test_a_nodes_text_is_split_where_a_block_stands(trees):
    nodes = html.parse("<div>a<p>b</p>c<b>d</b>e<script>x</script>f</div>")
    assert html.text_of(html_ordered(nodes), np.ones(len(nodes), bool)) == "a\n\nb\n\ncdef"


def html_ordered(nodes):
    html.features(nodes)
    return nodes


def test_quotes_of_unquoted_values_and_captions(trees):
    page = "<body><nav><a href=/>Home</a></nav><article title=it's><h1>A heading</h1><p title=it's class='x'>One good sentence, which goes on.</p><figure><img src=a.png alt=\"a > b\"><figcaption>What it shows</figcaption></figure><p>Another of them.</p></article><footer>Me</footer></body>"
    assert html.extract([page], trees)[0] == "A heading\n\nOne good sentence, which goes on.\n\nWhat it shows\n\nAnother of them."
