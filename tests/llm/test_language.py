"""Languages by held-out accuracy, distances against a plain version."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.language import Ranks, identify_languages, top_grams

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string"


def identified(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).withColumns(
        {c: F.lit("x") for c in ("content", "held_out", "lang_pred", "score", "n", "share", "gram")}
    )
    return identify_languages(df).collect()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in found)
    assert len(found) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for w in words:
        counts.update(w)
    line = f" {' '.join(words)} " if words else ""
    for n in (2, 3):
        counts.update(line[i : i + n] for i in range(len(line) - n + 1) if n == 2 or line[i + 1] != " ")
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:300]


def plain_distance(own, profile):
    return sum(abs(profile.index(g) - i) if g in profile else 400 for i, g in enumerate(own))


def number(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_ranks_against_plain():
    rng = random.Random(1)
    text = lambda letters, n: "".join(rng.choices(letters, k=n))
    sources = {"a": "abcdeé  ", "b": "bcdxyß  ", "c": "日本語のabc.1² "}
    profiles = {k: plain_grams(text(v, 3000))[:400] for k, v in sources.items()}
    ranks = Ranks({k: [number(g) for g in p] for k, p in profiles.items()})
    for _ in range(60):
        sample = text(rng.choice(list(sources.values())), rng.randrange(1, 200)) + rng.choice(["", "É", "²", "İ"])
        own = plain_grams(sample)
        assert top_grams(sample).tolist() == [number(g) for g in own]
        if own:
            best = min(sorted(profiles), key=lambda k: plain_distance(own, profiles[k]))
            score = 1 - plain_distance(own, profiles[best]) / (400 * len(own))
            assert ranks.closest(sample) == (best, score, True)


def test_edge_cases(spark):
    rows = [(i, "the of and that with this", "en") for i in range(20)]
    rows += [(100 + i, "der die und das nicht ein", "de") for i in range(20)]
    rows += [
        (None, "und nicht die", "fr"), (None, "und nicht die", None), (200, None, "fr"), (201, "", "fr"), (202, "12 ²³ !!_", "fr"),
        (203, "x", None), (204, "that of " * 50_000, None), (204, "that of " * 50_000, None), (205, "ΑΒΓ", None),
    ]
    got = identified(spark, rows)
    assert len(got) == len(rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (200, 201, 202)} == {"und"}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (200, 201, 202)) for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] == 204] == ["en", "en"]
    assert [(r["lang_pred"], r["held_out"]) for r in got if r["doc_id"] is None] == [("de", False)] * 2
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)


def test_every_language_has_a_profile(spark):
    letters = lambda k: f"{chr(0x4E00 + 2 * k)}{chr(0x4E01 + 2 * k)}"
    learned = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2][:1000]
    rows = [(i, f"{letters(n % 300)} " * 3, f"l{n % 300:03}") for n, i in enumerate(learned)]
    rows += [(5000 + k, letters(k), None) for k in range(300)]
    got = {r["doc_id"]: r["lang_pred"] for r in identified(spark, rows)}
    assert [got[5000 + k] for k in range(300)] == [f"l{k:03}" for k in range(300)]


def test_held_out_rows_are_not_learned_from(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    rows = [(i, "the of and that", "xx" if fold(i) == 2 else "en") for i in range(40)]
    assert {r["lang_pred"] for r in identified(spark, rows)} == {"en"}


def test_nothing_to_learn(spark):
    assert [(r["lang_pred"], r["score"]) for r in identified(spark, [(1, "text", None)])] == [("und", 0.0)]
    assert identified(spark, []) == []
