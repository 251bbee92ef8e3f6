"""SimHash groups against a plain version over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.components import SPREAD, components, with_least
from tidemark.llm.simhash import _forest, fingerprint, group_near_copies, links

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_print(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return sorted(
        ((doc, f"{p:016x}", least.get(g)) for (doc, _), p, g in zip(rows, prints, group)), key=repr
    )


def found(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def words(rng, n):
    return [rng.choice(["a", "of", "the", "Straße", "é", "x"]) + str(rng.randrange(400)) for _ in range(n)]


def test_edge_cases(spark):
    rows = [
        (7, None), (3, ""), (9, " \t\n\x0b\x0c\r "), (None, "A b"), (4, "a  B"), (4, "a\tb"), (4, "a\tb"),
        (5, "ÀB c d e"), (6, "àb c d e"), (8, "no break space here"), (None, "alone but for this one"),
    ]
    df = spark.createDataFrame(rows, DOCS).withColumns(
        {"component_id": F.lit("x"), "print": F.lit(1), "fingerprint": F.lit(2), "node": F.lit(3)}
    )
    assert found(group_near_copies(df)) == plain_groups(rows)


def test_near_copies(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(25):
        base = words(rng, rng.choice([3, 40, 300, 900]))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "edit"
            n += 1
            rows.append((1000 - n, " ".join(copy)))
    expected = plain_groups(rows)
    assert len({c for _, _, c in expected}) < len(rows)
    assert found(group_near_copies(spark.createDataFrame(rows, DOCS))) == expected


def test_long_text():
    rng = random.Random(1)
    text = " ".join(words(rng, 70_000))
    assert fingerprint(text.encode()) & (2**64 - 1) == plain_print(text)


def test_empty(spark):
    df = group_near_copies(spark.createDataFrame([], DOCS))
    assert df.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert df.collect() == []


def test_forest_connects_what_all_pairs_connect():
    import numpy as np

    rng = random.Random(2)
    for size in (2, 3, 50, 400):
        members = sorted(rng.sample(range(4096), size))
        linked = _forest(np.array(members, np.int32))
        assert all((a ^ b).bit_count() <= 2 for a, b in linked) and len(linked) < size

        def groups(pairs):
            g = {m: m for m in members}
            for a, b in pairs:
                old, new = max(g[a], g[b]), min(g[a], g[b])
                g = {m: new if x == old else x for m, x in g.items()}
            return g

        everything = [(a, b) for a in members for b in members if a < b and (a ^ b).bit_count() <= 2]
        assert groups(linked) == groups(everything)


def test_links_of_dense_prints(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(63), k)) for k in (1, 2, 3, 4) for _ in range(60)}
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    rows = links(df).collect()
    assert rows and all(r["shared_bytes"] >= 6 and 1 <= r["distance"] <= 2 for r in rows)
    near = {p: {q for q in prints if p != q and (p ^ q).bit_count() <= 2} for p in prints}
    assert {x for r in rows for x in (r["a"], r["b"])} == {p for p in prints if near[p]}


@pytest.mark.parametrize("shape", ["path", "star", "mixed"])
def test_components(spark, shape):
    rng = random.Random(4)
    pairs = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(60)],
        "mixed": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(1, None), (3, 3)],
    }[shape]
    rows = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    root = {r["node"]: r["root"] for r in rows}
    assert len(root) == len(rows)
    group = {x: x for p in pairs for x in p if None not in p}
    for a, b in pairs:
        if b is not None:
            low, high = sorted((group[a], group[b]))
            group = {n: low if g == high else g for n, g in group.items()}
    assert all(root.get(n, n) == g for n, g in group.items())


def test_minima_of_a_hub_are_made_in_parts(spark):
    """Half of the rows have one key: each is told its least value, and no task of either side has them all."""
    rows = [(0 if i % 2 else i % 97, i * 7919 % 10_007 if i % 5 else None, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "key long, value long, id long")
    expected = {}
    for key, value, _ in rows:
        if value is not None:
            expected[key] = min(value, expected.get(key, value))
    got = with_least(df, "key", "value", "id")
    assert sorted((r["key"], r["id"], r["low"]) for r in got.collect()) == sorted((k, i, expected[k]) for k, _, i in rows)
    shares = df.where("key = 0").groupBy(F.pmod(F.xxhash64("id"), F.lit(SPREAD))).count()
    assert shares.count() == SPREAD and shares.agg(F.max("count")).first()[0] < 120


def test_component_of_many_leaves(spark):
    """A star, whose centre is a hub from the first round to the last."""
    links = spark.range(1, 5001).selectExpr("id AS a", "0L AS b").unionByName(spark.range(1, 3000).selectExpr("id + 6000 AS a", "9000L AS b"))
    rows = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    assert rows == {**{i: 0 for i in range(1, 5001)}, **{i: 6001 for i in [*range(6002, 9000), 9000]}}
