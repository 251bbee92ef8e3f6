"""Repeated bytes against a plain search for every string of 400 bytes."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.repeats import anchors, factors, laid, merged, remove_repeats, repeated_starts

COLUMNS = "doc_id long, text string"


def plain(rows, keep_first=False):
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0))
    bodies = [(text or "").encode() for _, text in rows]
    places = defaultdict(list)
    for r in order:
        for s in range(len(bodies[r]) - 399):
            places[bodies[r][s : s + 400]].append((r, s))
    marked = [set() for _ in rows]
    for found in places.values():
        for r, s in found[1:] if keep_first else found if len(found) > 1 else ():
            marked[r].add(s)
    out = []
    for (doc, _), body, starts in zip(rows, bodies, marked):
        gone = bytearray(len(body))
        for s in starts:
            gone[s : s + 400] = b"\1" * 400
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((doc, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, COLUMNS).withColumns(
        {c: F.lit("x") for c in ("key", "anchor", "first", "size", "lead", "n", "times", "kept", "ranges", "n_bytes")}
    )
    out = remove_repeats(df, **options).drop("kept").collect()
    return sorted(map(tuple, out), key=repr)


def prose(rng, n):
    return "".join(rng.choices("abcdefgh éß\n", k=n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (300, 380, 399, 400, 401, 500, 900)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(10, 700))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(passages), prose(rng, rng.choice([0, 1, 50, 600]))]
        rows.append((i, "".join(parts)))
    base = prose(rng, 3000)
    for i in range(12):
        edited = list(base)
        for _ in range(rng.randrange(1, 6)):
            edited[rng.randrange(len(edited))] = "X" * rng.randrange(3)
        rows.append((100 + i, "".join(edited)))
    return rows


EDGES = [
    (1, None), (2, ""), (3, "short"), (4, "a" * 399), (5, "a" * 400), (6, "b" * 401), (7, "ab" * 300), (8, "abc" * 500),
    (None, "é" * 200), (None, "é" * 200), (9, "z" + "é" * 200), (10, "\0" * 450), (11, "x" + "\0" * 405), (12, "\0" * 399 + "y"),
]


@pytest.mark.parametrize("seed", range(2))
def test_random_corpora(spark, seed):
    rows = corpus(seed)
    expected = plain(rows)
    assert len({r[2] for r in expected}) > 20
    assert found(spark, rows) == expected


def test_edge_cases(spark):
    rng = random.Random(5)
    copied = prose(rng, 2000)
    rows = EDGES + [(20, copied), (20, copied), (21, copied[500:]), (22, prose(rng, 500) + copied[:399])]
    assert found(spark, rows) == plain(rows)


def test_copies_beyond_the_first(spark):
    rows = corpus(7) + [r for r in EDGES if r[0] is not None] + [(None, corpus(7)[3][1])]
    assert found(spark, rows, keep_first=True) == plain(rows, keep_first=True)


@pytest.mark.parametrize("keep_first", [False, True])
def test_anchors_with_many_pieces(spark, monkeypatch, keep_first):
    monkeypatch.setattr(repeats, "BUCKET_PIECES", 2)
    rows = corpus(3) + [(200, "a" * 2000), (201, "ab" * 700), (202, "b" + "ab" * 500)]
    assert found(spark, rows, keep_first=keep_first) == plain(rows, keep_first)


def test_long_text(spark, monkeypatch):
    rng = random.Random(6)
    passage = prose(rng, 700)
    long = "".join(prose(rng, 40_000) + passage for _ in range(4))
    rows = [(1, long), (2, long[17:]), (3, prose(rng, 500) + passage)]
    assert found(spark, rows) == plain(rows)


def test_kept_bytes(spark):
    rng = random.Random(8)
    passage, one, other = prose(rng, 600), prose(rng, 50) + "1", prose(rng, 50) + "2"
    rows = [(1, one + passage + one), (2, other + passage + other), (3, "unlike")]
    out = {r["doc_id"]: r["kept"] for r in remove_repeats(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert out[3] is None
    assert bytes(out[1]).decode() == 2 * one and bytes(out[2]).decode() == 2 * other


def test_anchors_cover_every_start_once():
    rng = random.Random(9)
    for text in (prose(rng, 5000), "ab" * 900, prose(rng, 300_000)):
        body = text.encode()
        runs = anchors(body).T.tolist()
        assert [r[2] for r in runs] == [0, *(r[2] + r[3] * r[5] for r in runs[:-1])]
        assert sum(r[3] * r[5] for r in runs) == len(body) - 399


def test_periodic_text_makes_few_rows(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 5000)
    rng = random.Random(10)
    for unit in ("a", "ab", "xyz" * 5 + "!", prose(rng, 150)):
        body = (prose(rng, 900) + unit * (300_000 // len(unit)) + prose(rng, 900)).encode()
        runs = anchors(body).T.tolist()
        assert len(runs) < 120
        assert sum(r[3] * r[5] for r in runs) == len(body) - 399


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(5))
def test_factors_are_the_longest_previous_ones(seed):
    """The arrays of one text, against a look at every earlier position."""
    rng = random.Random(seed)
    text = "".join(rng.choices("ab", k=rng.choice([1, 2, 40, 200])))
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0, *(common(text[i:], text[j:]) for i, j in zip(order, order[1:]))]
    found = factors(np.array(order), np.array(shared))
    expected = [max((common(text[i:], text[j:]) for j in range(i)), default=0) for i in order]
    assert found.tolist() == expected


@pytest.mark.parametrize("earlier_only", [False, True])
def test_pieces_of_several_anchors(earlier_only):
    rng = random.Random(11)
    bodies, leads, anchor, sizes = [], [], [], []
    for a in range(30):
        left, middle, right = (prose(rng, n).encode()[:200] for n in (220, 220, 220))
        for _ in range(rng.choice([1, 2, 3, 12])):
            line = bytearray(left + middle + right)
            for _ in range(rng.randrange(3)):
                line[rng.choice([rng.randrange(200), rng.randrange(400, 600)])] = rng.randrange(256)
            lead = rng.randrange(201)
            size = rng.randrange(1, lead + 2)
            bodies.append(bytes(line[200 - lead : 200 - lead + size + 399]))
            leads.append(lead)
            sizes.append(size)
            anchor.append(a)
    first = 200 - np.array(leads)
    marked = repeated_starts(laid(bodies, np.array(leads)), np.array(anchor), first, np.array(sizes), earlier_only)
    starts = defaultdict(list)
    for i, (body, a) in enumerate(zip(bodies, anchor)):
        for s in range(sizes[i]):
            starts[a, leads[i] - s, body[s : s + 400]].append((i, int(first[i]) + s))
    expected = {
        x for same in starts.values() for x in (same[1:] if earlier_only else same if len(same) > 1 else ())
    }
    assert expected and {tuple(x) for x in np.argwhere(marked).tolist()} == expected


def test_merged_ranges():
    begins, ends = merged(np.array([0, 2, 3, 10, 12, 20]), np.array([5, 4, 10, 11, 13, 25]))
    assert (begins.tolist(), ends.tolist()) == ([0, 12, 20], [11, 13, 25])


@pytest.mark.parametrize("keep_first", [False, True])
def test_periodic_texts(spark, keep_first):
    rng = random.Random(12)
    unit = prose(rng, 90)
    rows = [(1, "q" * 3000), (2, unit * 20), (3, "x" + unit * 12 + "y"), (4, "r" * 700 + "q" * 900), (5, unit * 3 + "z" * 5000)]
    assert found(spark, rows, keep_first=keep_first) == plain(rows, keep_first)


def test_empty(spark):
    assert found(spark, []) == []
