"""The mix against a plain queue over all copies."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.mixing import mix

COLUMNS = "doc_id long, text string, source string"


def shuffle_key(doc, text):
    parts = ["" if doc is None else str(doc)] + ([] if text is None else [hashlib.md5(text.encode()).hexdigest()])
    return hashlib.md5(":".join(parts).encode()).hexdigest()


def plain(rows):
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    budget, full = sum(total.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        level = (budget - sum(3 * total[s] for s in full)) / free if free else 0.0
        over = {s for s in names if 3 * total[s] <= level * weight[s]}
        if over == full or not free:
            break
        full = over
    target = {s: min(3.0 * total[s], level * weight[s]) for s in names}
    queued, entries = [], []
    for s in names:
        own = [(shuffle_key(d, t), size(t), d is not None, d or 0, d) for d, t, x in rows if x == s]
        upto = 0
        for _, n, _, _, d in sorted(own):
            upto += n
            finish = [(upto + e * total[s]) / weight[s] for e in range(3)]
            queued.append((d, s, n, total[s], target[s], finish))
            entries += [(f, n) for f in finish if n]
    words, end = 0, float("inf")
    for f in sorted({f for f, _ in entries}):
        words += sum(n for g, n in entries if g == f)
        if words > budget:
            end = f
            break
    return sorted(((d, s, n, t, round(g, 6), n * sum(f < end for f in fs)) for d, s, n, t, g, fs in queued), key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    df = df.withColumns({c: F.lit("x") for c in ("size", "bucket", "upto", "weight", "content", "target")})
    out = mix(df).select("doc_id", "source", "size", "source_size", F.round("target", 6), "taken")
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "Z", "é", "src10", "src2", "big"]
    rows = []
    for i in range(300):
        source = "big" if rng.random() < 0.4 else rng.choice(names)
        rows.append((i, "w " * rng.choice([0, 1, 3, 20, 200]), source))
    assert found(spark, rows) == plain(rows)


def test_edge_cases(spark):
    rows = [
        (1, None, "a"), (None, "x y", "a"), (None, "x y", "a"), (2, "", "a"), (3, "p q r", None), (3, "p q r", None),
        (3, "p q", "b"), (4, "   ", "c"), (5, " \x0b\t\n", "d"), (6, "w " * 5000, "big"),
    ]
    assert found(spark, rows) == plain(rows)


def test_all_empty(spark):
    rows = [(1, None, "a"), (2, "", None)]
    assert found(spark, rows) == [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]
    assert found(spark, []) == []


def test_result_does_not_depend_on_buckets(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice(["a", "b", "c"])) for i in range(400)]
    once = found(spark, rows)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 0.01)
    assert found(spark, rows) == once


def test_sources_come_near_their_targets(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice("aaaaaabcdef")) for i in range(3000)]
    out = found(spark, rows)
    for source in "abcdef":
        taken = sum(r[5] for r in out if r[1] == source)
        target = next(r[4] for r in out if r[1] == source)
        assert abs(taken - target) < 120
    assert all(r[5] <= 3 * r[2] for r in out)


def test_rows_without_an_id_are_dealt_out(spark):
    """10,000 rows of null id lie in as many buckets as others."""
    rows = [(None, f"w{i} x", "a") for i in range(10_000)]
    keys = {shuffle_key(d, t)[:2] for d, t, _ in rows}
    assert len(keys) == 256
    assert found(spark, rows) == plain(rows)
