"""Importance resampling against plain counting of all word runs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import resample as module
from tidemark.llm.resample import Hasher, head_without_pairs, in_order, pieces, resample, shifted

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_buckets(text):
    words = plain_words(text)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(docs, items):
    """(doc_id, n_features, weight, score, rank), sorted."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_buckets(text))
    for text in items:
        t.update(plain_buckets(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    rows, pool = [], []
    for at, (doc, text) in enumerate(docs):
        buckets = plain_buckets(text)
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(buckets), weight, score, None])
        if len(plain_words(text)) >= 20:
            pool.append((-score, doc is None, doc or 0, at))
    for rank, (*_, at) in enumerate(sorted(pool)[: 5 * len(pool) // 100], 1):
        rows[at][4] = rank
    return sorted(map(tuple, rows), key=repr)


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("word", "n", "weight", "score", "rank", "place", "part", "nth")})
    items = spark.createDataFrame([(t,) for t in items], "text string").withColumn("bucket", F.lit("x"))
    rows = resample(docs, items).drop("n_words").collect()
    return sorted(map(tuple, rows), key=repr)


def test_edge_cases(spark):
    long = "x" * 70
    docs = [
        (1, None), (2, ""), (3, " ,.- "), (4, "Solo"), (5, "two Words"), (6, "ÜNÏ straße A1 " * 9), (None, "a b c " * 12),
        (None, "a b c " * 12), (7, f"{long} a {long} {long} b " * 6), (8, f"{'y' * 5000} " * 30), (8, "a b c " * 12),
        (8, "a b c " * 12), (9, "w " * 19), (10, "w " * 20), (-3, "b\0c\x7fd " * 20),
    ]
    docs += [(100 + i, f"a b c d{i} " * 8) for i in range(60)]
    items = ["a b c d", None, "", f"{long} a", "solo", "ünï STRASSE"]
    expected = plain(docs, items)
    assert found(spark, docs, items) == expected
    assert sum(r[4] is not None for r in expected) == 3


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    docs = [(1, "a b c"), (2, None)]
    assert found(spark, docs, []) == plain(docs, [])


@pytest.mark.parametrize("seed", range(2))
def test_random_texts_with_a_small_head(spark, monkeypatch, seed):
    """Tails, heads, pairs in and out of the head, and texts cut into pieces all agree."""
    rng = random.Random(seed)
    words = [f"{'wé'[: 1 + i % 2]}{i}" for i in range(40)] + ["z" * 64, "z" * 65, "ö" * 33]
    docs = [(i, " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.choice([3, 30, 200])))) for i in range(120)]
    docs += [(500 + i, docs[0][1]) for i in range(80)]
    items = [" ".join(rng.choices(words, k=15)) for _ in range(10)]
    for name, value in (("HEAD_WORDS", 20), ("PAIRED_WORDS", 6), ("HEAD_PAIRS", 9), ("PIECE_BYTES", 50), ("BLOCK_WORDS", 64)):
        monkeypatch.setattr(module, name, value)
    assert found(spark, docs, items) == plain(docs, items)


def test_pieces_cover_a_text(monkeypatch):
    monkeypatch.setattr(module, "PIECE_BYTES", 7)
    text = b"aa bb cccccccccccccccc d e  f " + b"g" * 30 + b" h i,j"
    got = list(pieces(text))
    assert [w for words, before in got for w in words[before:]] == module.WORD.findall(text)
    assert all(words[:before] == (got[k - 1][0])[-2:][-before:] for k, (words, before) in enumerate(got) if before)


def test_states_are_those_of_the_joined_bytes():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(1, 30)), rng.randbytes(rng.randrange(0, 60))) for _ in range(500)]
    first = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    second = np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    joined = shifted(first, np.array([len(b) for _, b in pairs])) ^ second
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]
    blocks = list(Hasher(head_without_pairs([b"a", b"bb"])).blocks([b"A bb c", None, b"bb"]))
    assert [x for w in blocks for x in w.three[w.depth > 1].tolist()] == [zlib.crc32(b"a bb c")]


def test_order_of_many_equal_rows(spark):
    """Places are 1 to n, also where a third of all rows have one key."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("nth"))
    rows = in_order(df, F.desc("k"), F.col("nth").asc()).collect()
    assert [r["place"] for r in sorted(rows, key=lambda r: (-r["k"], r["nth"]))] == list(range(1, 3001))
