"""The main text of web pages, by boosted trees over the blocks of their DOM.

Trees are trained on two kinds of pages: a sample of the given ones, labelled by their own
`article` or `main` element, and made ones with other templates, whose parts are known.
Their probabilities for the blocks of a page are decoded together, from the leaves up, so
that nothing is kept inside a block that is left out.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.dom import BOILERPLATE_TAGS, FEATURES, TAG_GROUPS, TOKEN_GROUPS, Node, decode, features, parse
from tidemark.plans.staging import new_table_path, stage

#: Pages of the given table that are learned from, about, chosen by hash; made pages.
SAMPLE_PAGES = 300
MADE_PAGES = 700
TREES, DEPTH, STEP = 40, 5, 0.3
TRAINING_PARTITIONS = 4
#: Blocks whose probabilities are computed at a time.
BLOCKS_AT_ONCE = 8192

_TAGS, _TOKENS = list(TAG_GROUPS), list(TOKEN_GROUPS)
_OUTSIDE = frozenset(i for i, t in enumerate(_TOKENS) if t in ("nav", "ad", "comment", "notice", "form", "side", "footer", "share"))
_OUTSIDE_TAGS = frozenset(tag for g in BOILERPLATE_TAGS for tag in TAG_GROUPS[g].split())


def made_page(seed: int) -> str:
    """A page of a template of its own; `data-gold` tells which parts are the main text."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choices(("a", "en", "ro", "ti", "s", "lu", "ké", "o"), k=rng.randrange(1, 5)))

    def prose(low: int, high: int) -> str:
        words, out = rng.randrange(low, high), []
        while words > 0:
            n = min(words, rng.randrange(4, 18))
            out.append(" ".join(word() for _ in range(n)).capitalize() + rng.choice(".....!?"))
            words -= n
        return " ".join(out)

    def tokens(*groups: str) -> str:
        names = rng.choice(TOKEN_GROUPS[rng.choice(groups)].split())
        prefix = rng.choice(("", "", "site-", "js-", "c-", "main ", "box "))
        return f' {rng.choice(("class", "class", "id"))}="{prefix}{names}"'

    def links(low: int, high: int) -> str:
        items = [f'<li><a href="/{word()}">{prose(1, 4)}</a>' for _ in range(rng.randrange(low, high))]
        return "<ul>" + rng.choice(("", "</li>")).join(items) + "</ul>"

    def paragraph(low: int = 1, high: int = 130) -> str:
        text = prose(low, high)
        if rng.random() < 0.3:
            text = f"<b>{text}" + rng.choice(("</b>", "<br>", "</b><br>"))
        if rng.random() < 0.2:
            text += f' <a href="/x">{prose(1, 4)}</a> {prose(1, 8)}'
        return f"<p>{text}" + rng.choice(("</p>", "</p>", ""))

    def box(kinds: tuple[str, ...], body: str, groups: tuple[str, ...], plain: bool = False) -> str:
        tag = rng.choice(kinds)
        named = "" if plain or (tag not in ("div", "section", "ul", "p") and rng.random() < 0.6) else tokens(*groups)
        return f'<{tag}{named} data-gold="0">{body}</{tag}>'

    def boilerplate() -> list[str]:
        kinds = [
            lambda: box(("nav", "div", "div"), links(2, 12), ("nav",)),
            lambda: box(("div", "section", "aside"), rng.choice((prose(2, 40), paragraph(2, 40), links(1, 4))), ("ad",)),
            lambda: box(("div", "section"), paragraph(4, 60) * rng.randrange(1, 3), ("notice",)),
            lambda: box(("aside", "div", "div"), f"<h3>{prose(1, 4)}</h3>" + rng.choice((links(2, 9), paragraph(4, 40))), ("side",)),
            lambda: box(("form", "form", "div"), f"<label>{prose(1, 5)}</label><input><button>{word()}</button>", ("form",)),
            lambda: box(("div", "ul"), links(2, 6), ("share",)),
            lambda: box(("div", "section"), "".join(f"<div{tokens('comment')}>{paragraph(3, 90)}</div>" for _ in range(rng.randrange(1, 6))), ("comment",)),
        ]
        return [rng.choice(kinds)() for _ in range(rng.randrange(1, 4))]

    def inner() -> str:
        parts = [f"<h1>{prose(1, 12)}</h1>"] if rng.random() < 0.85 else []
        if parts and rng.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = rng.random()
            if kind < 0.08:
                parts.append(f"<h2>{prose(1, 8)}</h2>")
            elif kind < 0.14:
                parts.append("<ul>" + "".join(f"<li>{prose(2, 25)}</li>" for _ in range(rng.randrange(1, 6))) + "</ul>")
            elif kind < 0.18:
                parts.append(f"<blockquote>{paragraph()}</blockquote>")
            elif kind < 0.21:
                parts.append("<table>" + f"<tr><td>{prose(1, 4)}<td>{prose(1, 4)}" * 3 + "</table>")
            elif kind < 0.25:
                parts.append(f"<div>{prose(4, 90)}</div>")
            elif kind < 0.31:
                parts += boilerplate()[:1]
            else:
                parts.append(paragraph())
        return "".join(parts)

    tag = rng.choice(("article", "article", "main", "div", "div", "section"))
    named = tokens("content") if tag in ("div", "section") or rng.random() < 0.2 else ""
    main = f'<{tag}{named} data-gold="1">{inner()}</{tag}>'
    if rng.random() < 0.3:
        main = f'<div{rng.choice(("", tokens("content")))}>{main}</div>'
    head = box(("header", "div"), f"<p>{prose(1, 6)}</p>" + rng.choice(("", links(2, 9))), ("header",))
    foot = box(("footer", "footer", "div"), rng.choice((f"&copy; {prose(2, 30)}", paragraph(2, 40), links(1, 8))), ("footer",))
    before = ([head] if rng.random() < 0.6 else []) + (boilerplate() if rng.random() < 0.8 else [])
    after = (boilerplate() if rng.random() < 0.6 else []) + ([foot] if rng.random() < 0.85 else [])
    body = "".join([*before, main, *after])
    for _ in range(rng.randrange(3)):
        body = f"<div{rng.choice(('', ' id=page', ' class=wrapper'))}>{body}</div>"
    return f"<html><head><title>{prose(1, 8)}</title></head><body>{body}</body></html>"


def _labels(nodes: list[Node], made: bool) -> np.ndarray | None:
    """Which blocks hold main text; None for a page that does not tell."""
    if not made and sum(n.tag in ("article", "main") for n in nodes) != 1:
        return None
    inside = {id(nodes[0]): False}
    labels = np.zeros(len(nodes))
    for i, node in enumerate(nodes[1:], 1):
        state = inside[id(node.parent)]
        if made:
            state = node.gold == "1" if node.gold is not None else state
        elif node.tag in ("article", "main"):
            state = True
        elif node.tag in _OUTSIDE_TAGS or node.tokens & _OUTSIDE:
            state = False
        inside[id(node)] = state
        labels[i] = state and not node.tag
    at = {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        parent = at[id(nodes[i].parent)]
        labels[parent] = max(labels[parent], labels[i])
    return labels


def _training_blocks(pages: Iterable[str | None], made: bool) -> pa.RecordBatch:
    rows, labels = [np.zeros((0, len(FEATURES)), np.float32)], [np.zeros(0)]
    for html in pages:
        nodes = parse(html)
        known = _labels(nodes, made)
        if known is not None:
            rows.append(features(nodes))
            labels.append(known)
    table = np.concatenate(rows).astype(np.float64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(labels)), pa.array(list(table), pa.list_(pa.float64()))], ["label", "measures"]
    )


def _given(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _training_blocks((t.as_py() for t in batch.column(0)), made=False)


def _made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _training_blocks((made_page(seed.as_py()) for seed in batch.column(0)), made=True)


#: Of each node of a tree: the feature it splits by, the limit, left and right child (a
#: leaf has itself) and the weighted value.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def as_arrays(rows: list, weights: list[float]) -> list[Tree]:
    """A fitted ensemble, given by the rows of its saved form, for use on many rows at once."""
    ensemble: dict[int, list] = {}
    for row in rows:
        ensemble.setdefault(row["treeID"], []).append(row["nodeData"])
    trees = []
    for tree, weight in zip((ensemble[k] for k in sorted(ensemble)), weights):
        nodes = sorted(tree, key=lambda n: n["id"])
        leaf = np.array([n["leftChild"] < 0 for n in nodes])
        own = np.arange(len(nodes))
        feature = np.where(leaf, 0, [n["split"]["featureIndex"] for n in nodes])
        limit = np.array([(n["split"]["leftCategoriesOrThreshold"] or [0.0])[0] for n in nodes])
        left = np.where(leaf, own, [n["leftChild"] for n in nodes])
        right = np.where(leaf, own, [n["rightChild"] for n in nodes])
        trees.append((feature, limit, left, right, weight * np.array([n["prediction"] for n in nodes])))
    return trees


def probabilities(trees: list[Tree], table: np.ndarray) -> np.ndarray:
    """The probability of each row."""
    margin, rows = np.zeros(len(table)), np.arange(len(table))
    for feature, limit, left, right, value in trees:
        at = np.zeros(len(table), np.int64)
        for _ in range(DEPTH):
            at = np.where(table[rows, feature[at]] <= limit[at], left[at], right[at])
        margin += value[at]
    return 1 / (1 + np.exp(-2 * margin))


def fit_trees(spark: SparkSession, pages: DataFrame, sample_pages: int = SAMPLE_PAGES, made_pages: int = MADE_PAGES) -> list[Tree]:
    """Trees trained on a sample of `pages` (page_id, url, html) and on made pages.

    Pages are chosen by a hash of the whole row, so that neither a repeated id nor a url
    that many pages have brings more of them; those without an id are left out.
    """
    modulus = 1 << 30
    share = min(1.0, sample_pages / max(1, pages.count()))
    known = pages.where(F.col("page_id").isNotNull())
    chosen = known.where(F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(modulus)) < int(share * modulus))
    schema = "label double, measures array<double>"
    given = chosen.select("html").mapInArrow(_given, schema)
    made = spark.range(0, made_pages, 1, TRAINING_PARTITIONS).mapInArrow(_made, schema)
    blocks = stage(given.unionByName(made).repartition(TRAINING_PARTITIONS), "blocks")
    rows = blocks.select("label", array_to_vector("measures").alias("features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=11).fit(rows)
    # The saved form is the one that has the nodes as a table.
    path = new_table_path(spark, "trees")
    model.write().save(path)
    return as_arrays([row.asDict(True) for row in spark.read.parquet(f"{path}/data").collect()], model.treeWeights)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`.

    `text` joins the blocks that are kept in page order by one space; inside a block
    character references are decoded and white space is one space. Null, empty and
    text-free pages have an empty text. Null ids and urls and repeated rows are kept;
    other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    narrow = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")
    )
    shared = spark.sparkContext.broadcast(fit_trees(spark, narrow))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value

        def texts(parsed: list[list[Node]]) -> list[str]:
            table = np.concatenate([features(nodes) for nodes in parsed]).astype(np.float64)
            chances = probabilities(trees, table)
            ends = np.cumsum([len(nodes) for nodes in parsed])
            return [decode(nodes, part) for nodes, part in zip(parsed, np.split(chances, ends))]

        for batch in batches:
            found, parsed, blocks = [], [], 0
            for html in batch.column(2):
                parsed.append(parse(html.as_py()))
                blocks += len(parsed[-1])
                if blocks >= BLOCKS_AT_ONCE:
                    found += texts(parsed)
                    parsed, blocks = [], 0
            if parsed:
                found += texts(parsed)
            lengths = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), lengths],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
