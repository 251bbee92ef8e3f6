"""Main text of given pages and of made ones that were not trained on; decoding by brute force."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.dom import Node, decode, features, parse
from tidemark.llm.pages import MADE_PAGES, _labels, extract_main_text, made_page

SF = "/root/testdata/sf0.01"


def article(page):
    """The text of the one article of a test page."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())


@pytest.fixture(scope="module")
def extracted(spark):
    """Given pages, made pages and special cases, by one set of trees."""
    given = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    seeds = range(MADE_PAGES, MADE_PAGES + 150)
    made = [(1_000_000 + s, "made", made_page(s)) for s in seeds]
    pages = given.unionByName(spark.createDataFrame(made + SPECIAL, given.schema))
    pages = pages.withColumns({c: F.lit("x") for c in ("text", "n_chars", "label", "measures", "features")})
    return {(r["page_id"], r["url"]): r for r in extract_main_text(pages).collect()}, given.collect(), made


LONG = " ".join(f"word{i}" for i in range(60_000))
SPECIAL = [
    (None, None, None), (-1, "a", ""), (-2, "a", "   \n "), (-3, "a", "<html><body></body></html>"),
    (-4, "a", "<script>var a='<p>x</p>';</script><style>p{}</style><!-- <p>no</p> -->"),
    (-5, "a", "<body><article><h1>One &amp; two</h1><p>A&nbsp;b&#233;\n\t c &lt;d&gt;. Of the one and the other.<p>And<b> so</b> on, as ever.</article><footer>&copy; x</footer>"),
    (-6, "a", "<body><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><article><p>The first of all the words, and the last"),
    (-7, "a", f"<body><article><p>{LONG}</p></article><footer>&copy; x</footer></body>"),
    (-8, "a", "<div>" * 3000 + "deep" + "</div>" * 3000), (-9, "a", "<p <b <"), (-9, "b", "</p></div></x>"),
]


def test_given_pages(extracted):
    found, given, _ = extracted
    for row in given:
        text = found[row["page_id"], row["url"]]["text"]
        assert text == article(row["html"])


def test_made_pages_of_other_seeds(extracted):
    found, _, made = extracted
    right = total = 0
    for page, url, body in made:
        nodes = parse(body)
        gold = " ".join(n.text for n, known in zip(nodes, _labels(nodes, True)) if known and not n.tag)
        own, true = found[page, url]["text"].split(), gold.split()
        both = len(own) + len(true)
        common = sum(min(own.count(w), true.count(w)) for w in set(true))
        right += 2 * common / both if both else 1
        total += 1
    assert right / total > 0.93


def test_special_pages(extracted):
    found, _, _ = extracted
    texts = {k: r["text"] for k, r in found.items()}
    assert all(texts[k] == "" for k in [(None, None), *((-i, "a") for i in range(1, 5))])
    assert texts[-5, "a"] == "One & two A bé c <d>. Of the one and the other. And so on, as ever."
    assert texts[-6, "a"] == "The first of all the words, and the last"
    assert texts[-7, "a"] == LONG
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_parts_that_are_left_out():
    page = "<body><p>One<p>two<div>three<br>3<ul><li>four<li>five</ul>six</div><table><tr><td>a<td>b</table>"
    assert [n.text for n in parse(page) if not n.tag] == ["One", "two", "three 3", "four", "five", "six", "a", "b"]


@pytest.mark.parametrize("inner", ["div", "li", "td", "button"])
def test_nested_blocks_take_time_in_proportion(inner):
    """100,000 levels, below elements that would be looked for in vain."""

    def seconds(levels):
        page = f"<p><button><ul><li><table><tr><td>{f'<{inner}>' * levels}deep<p>er{f'</{inner}>' * levels}</td>"
        began = time.perf_counter()
        nodes = parse(page)
        features(nodes)
        assert " ".join(n.text for n in nodes if not n.tag) == "deep er"
        return time.perf_counter() - began

    few, many = min(seconds(5_000) for _ in range(3)), seconds(100_000)
    assert many < 20 * max(few, 0.05) * 5


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(1)
    for _ in range(60):
        nodes = [Node("html", None)]
        for i in range(rng.randrange(1, 9)):
            node = Node("div" if rng.random() < 0.5 else "", rng.choice([n for n in nodes if n.tag]))
            node.text = f"t{i}"
            nodes.append(node)
        order, stack = [], [nodes[0]]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(reversed(node.children))
        chances = np.array([rng.random() for _ in order])
        best, choice = -1e9, None
        for states in itertools.product([False, True], repeat=len(order) - 1):
            state = dict(zip(map(id, order), (True, *states)))
            if all(state[id(n.parent)] or not state[id(n)] for n in order[1:]):
                score = sum(np.log(p if state[id(n)] else 1 - p) for n, p in zip(order, chances))
                if score > best:
                    best, choice = score, " ".join(n.text for n in order if not n.tag and state[id(n)])
        assert decode(order, chances) == choice


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    out = extract_main_text(empty)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert out.collect() == []
