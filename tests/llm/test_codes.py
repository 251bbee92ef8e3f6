"""Vector codes against plain loops over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes as module
from tidemark.llm.codes import Nearest, codebooks_digest, compress

NAN, INF = float("nan"), float("inf")


def plain(rows, entries=256):
    kept = [
        (i, label, [math.floor(1024 * x) for x in v])
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // 4 if kept else 0
    cut = [[v[p * width : (p + 1) * width] for p in range(4)] for _, _, v in kept]
    books = [[parts[p] for parts in cut[:entries]] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            groups = {}
            for parts in cut:
                groups.setdefault(nearest(parts[p], books[p])[1], []).append(parts[p])
            books[p] = [
                [sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])
            ]
    found = [[nearest(parts[p], books[p]) for p in range(4)] for parts in cut]
    errors = {}
    for (_, label, _), f in zip(kept, found):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [
        (i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[label]) for (i, label, _), f in zip(kept, found)
    ]
    return sorted(out, key=repr), digest


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({c: F.lit("x") for c in ("whole", "code", "error", "part", "entry", "label_error")})
    codes, books = compress(df, **options)
    return sorted(map(tuple, codes.drop("label").collect()), key=repr), codebooks_digest(books)


def single(values):
    return [float(np.float32(x)) for x in values]


def test_edge_cases(spark):
    rng = random.Random(3)
    rows = [(i, single(rng.gauss(0, 0.2) for _ in range(8)), rng.choice([None, 0, 1])) for i in range(30)]
    rows += [
        (-5, None, 1), (-4, [0.0] * 7 + [None], 1), (-3, [NAN] + [0.0] * 7, 1), (-2, [INF] * 8, 0), (-1, [-INF] * 8, None),
        (None, rows[3][1], None), (None, rows[3][1], None), (7, rows[4][1], 0), (7, rows[4][1], 0), (40, [0.0] * 8, 2),
        (41, [-0.0] * 8, 2), (42, [100.0, -100.0] * 4, 2),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, entries=5) == plain(rows, 5)


def test_ties_and_copies(spark):
    rows = [(i, single([(i % 4) / 2] * 8), i % 2) for i in range(600)] + [(600 + i, [0.25] * 8, None) for i in range(300)]
    assert got(spark, rows) == plain(rows)


def test_nothing_kept(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, []) == ([], empty)
    assert got(spark, [(1, None, 1), (2, [NAN] * 4, 1)]) == ([], empty)


def test_lengths(spark):
    rows = [(1, [0.5] * 4, 0), (2, [0.5] * 8, 0), (3, [0.25] * 4, 0), (4, [], 0)]
    assert got(spark, rows)[0] == plain([rows[0], rows[2]])[0]
    assert got(spark, [(1, [0.5] * 3, 0)])[0] == []
    assert got(spark, [(1, [], 0), (2, [], 1)])[0] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]


def test_too_large(spark):
    with pytest.raises(Exception, match="a component is larger"):
        got(spark, [(1, [1e9] * 4, 0)])


@pytest.mark.parametrize("remembered", [1, 40, 1 << 15])
def test_nearest_entry_with_any_memory(monkeypatch, remembered):
    """What is cached, forgotten or found anew does not change the nearest entry."""
    monkeypatch.setattr(module, "REMEMBERED", remembered)
    monkeypatch.setattr(module, "PAIR_CHUNK", 100)
    rng = np.random.default_rng(5)
    book = rng.integers(-300, 300, (200, 4))
    book[50:60] = book[10:20]
    nearest = Nearest(book)
    for _ in range(3):
        values = np.concatenate([rng.integers(-400, 400, (500, 4)), book, np.repeat(book[:3], 50, axis=0)])
        apart = ((values[:, None] - book[None]) ** 2).sum(2)
        entry, distance = nearest(values)
        assert entry.tolist() == apart.argmin(1).tolist()
        assert distance.tolist() == apart.min(1).tolist()
        assert len(nearest.memory) <= remembered


def test_cells_leave_few_entries():
    rng = np.random.default_rng(6)
    nearest = Nearest(rng.normal(0, 130, (256, 16)).astype(np.int64))
    values = rng.normal(0, 130, (200, 16)).astype(np.int64)
    nearest(values)
    assert np.mean([len(x) for x in nearest.memory.values()]) < 128
