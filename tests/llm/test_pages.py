"""Blocks of odd markup, Viterbi against all labellings, and held-out pages."""

import itertools

import time

import numpy as np
import pytest

from tideline.llm import pages

SCHEMA = "page_id long, url string, html string, text string, k0 long"
ODD = {
    None: [], "": [], "   ": [], "plain": ["plain"], "<div id=x>a<p>b<li>c</div>d": ["a", "b", "c", "d"], "a<b": ["a"], "a < b <": ["a < b <"],
    "<p>x<!-- y": ["x"], "<script>a</script": [], "x&amp;y &#233; &lt;b&gt;<td>1<td>2": ["x&y é <b>", "1", "2"], "<p>a \n b</p>" * 2: ["a b"] * 2,
    "<textarea>foo</textarea>bar": ["bar"], "</p></div>x": ["x"], "<a title='>'>t</a>u": ["tu"], "<style>p{}</style><b>a</b>c<!DOCTYPE x>": ["ac"],
}


def test_leaf_blocks():
    for page, want in ODD.items():
        assert [b.text for b in pages.leaf_blocks(page)] == want, page
    assert pages.leaf_blocks("<ul><li>a<li>b</ul>")[1].path == (("ul", ""), ("li", ""))
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [b.text for b in pages.leaf_blocks(deep)] == ["x"]


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        field = pages.Field(rng.normal(size=(20, 2)), rng.normal(size=(2, 2)))
        features = [list(rng.integers(0, 20, 4)) for _ in range(n)]
        scores = field.scores(features)

        def worth(labels):
            return scores[np.arange(n), labels].sum() + sum(field.follows[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=lambda x: worth(list(x)))
        assert field.decode(features) == list(best)


def test_held_out_layouts_and_odd_rows(spark):
    words = "one two three four five six seven eight nine ten".split()
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, rng.integers(3, 20))).capitalize() + "." for _ in range(600)]
    rows = [(i, f"http://h/{i}", f"<title>{texts[i]}</title><article>" + "".join(f"<p>{t} {u}</p>" for t, u in zip(texts[i:], texts[i + 5 : i + 9])) + "</article>", "clash", 1) for i in range(80)]
    rows += [(1000 + i, None, page, None, 2) for i, page in enumerate(ODD)] + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    field = pages.fit(df, layouts=250)
    right = total = 0
    for page, content in pages.labelled_pages(texts, 60, seed=99):
        blocks = pages.leaf_blocks(page)
        labels = pages.labels_of(blocks, content)
        assert sum(labels) == len(content)
        right += sum(a == b for a, b in zip(labels, field.decode(pages.block_features(blocks))))
        total += len(labels)
    assert right / total > 0.97
    got = pages.extract(df, field).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and r.page_id < 80:
            assert r.text == " ".join(f"{t} {u}" for t, u in zip(texts[r.page_id :], texts[r.page_id + 5 : r.page_id + 9]))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pages.extract(empty, pages.Field(np.zeros((pages.FEATURES, 2)), np.zeros((2, 2)))).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div>word word. " * 100_000,
        "<span>word word. " * 20_000 + "<p>text. " * 40_000,
        "<b><i>" * 50_000 + "</p>" * 50_000 + "end.",
        "<div class='a%d'>x. " * 1 + "".join(f"<div class='n{i}'>x. " for i in range(50_000)),
        "<p " * 200_000 + '"',
        "<a href='x>text " * 100_001,
        "<ul>" * 30_000 + "<li>x. " * 60_000,
        "<td>" * 60_000 + "<tr>x. " * 60_000,
        "<p>" + "many plain words. " * 300_000 + "</p>",
    ],
    ids=["blocks", "inline", "stray", "names", "quote", "quotes", "lists", "cells", "long"],
)
def test_pages_of_any_shape_take_linear_time(page):
    field = pages.Field(np.zeros((pages.FEATURES, 2)), np.zeros((2, 2)))
    began = time.process_time()
    blocks = pages.leaf_blocks(page)
    assert len(field.labels(blocks)) == len(blocks)
    assert time.process_time() - began < 25


def test_scores_of_nested_pages_are_those_of_all_features():
    rng = np.random.default_rng(3)
    field = pages.Field(rng.normal(size=(pages.FEATURES, 2)), rng.normal(size=(2, 2)))
    tags = ["div class='a b'", "div class='b'", "p", "/p", "/div", "ul", "li", "/ul", "a href=x", "/a", "span id=q", "title", "/title", "td", "tr"]
    for _ in range(60):
        page = "".join(f"<{rng.choice(tags)}>word {i}. " for i in range(60))
        blocks = pages.leaf_blocks(page)
        assert np.allclose(field.scores(pages.own_features(blocks)) + field.around(blocks), field.scores(pages.block_features(blocks)))
        for block in blocks:
            want = {f"in {t}" for t, _ in block.path} | {f"name {n}" for _, names in block.path for n in names.split()}
            node, added = block.node, []
            while node:
                added += node.added
                node = node.parent
            assert sorted(added) == sorted(map(pages._number, want))


def test_a_quote_that_is_not_closed():
    assert [b.text for b in pages.leaf_blocks('<p>one</p><p title="two>three</p><p>four</p>')] == ["one", "three", "four"]
