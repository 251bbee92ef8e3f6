"""Counts and distances against a plain version; verdicts on clean and broken texts."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.quality import distance, judge_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string"


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed,
    )


def judged(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).withColumns(
        {c: F.lit("x") for c in ("language", "chars", "words", "kept", "w", "n_words", "space", "share")}
    )
    return judge_quality(df).collect()


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(spark, rows):
    got = judged(spark, rows)
    assert sorted(((r["doc_id"], *(r[c] for c in BASE)) for r in got), key=repr) == sorted(
        ((d, *plain(t)) for d, t, _ in rows), key=repr
    )
    assert not any(r["kept"] and r["base_failed"] for r in got)
    return got


def test_edge_cases(spark):
    eight = "a b c d e f g h"
    rows = [
        (1, None, "en"), (2, "", None), (3, " \t\x0b\x0c\r\n", ""), (None, "#*$%&|<> é😀 x", "en"), (4, eight, "en"),
        (5, f"{eight} {eight}", "en"), (6, f"{eight} a", "xx"), (7, "a " * 9, "en"), (8, "x\nx\n \n \nx y\nx  y\nx", "en"),
        (9, f"{eight} {eight} " + " ".join(map(str, range(60))), "en"), (9, f"{eight} {eight} " + " ".join(map(str, range(60))), "en"),
        (10, "word " * 60_000, "en"), (11, " ".join(map(str, range(60_000))), None),
    ]
    check(spark, rows)


def prose(rng, n, words):
    common = ["the", "of", "and", "to", "in"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)) + "."


def test_random_texts_and_verdicts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeiourstln", k=rng.randrange(3, 9))) for _ in range(3000)]
    rows = [(i, prose(rng, rng.randrange(1, 400), words), rng.choice(["en", "en", "xx"])) for i in range(200)]
    rows += [(1000 + i, prose(rng, 150, words).upper().replace(" ", "!! "), "en") for i in range(8)]
    rows += [(2000 + i, " ".join(rng.choices(words, k=200)), "en") for i in range(8)]
    rows += [(3000 + i, ("\n".join([prose(rng, 12, words)] * 3) + "\n") * rng.randrange(1, 4), None) for i in range(30)]
    got = {r["doc_id"]: r for r in check(spark, rows)}
    assert all(got[d]["kept"] for d, *_ in rows if d < 1000 and not got[d]["base_failed"])
    assert not any(got[d]["kept"] for d, *_ in rows if 1000 <= d < 3000)


def test_classes_and_words_of_any_script(spark):
    texts = ["Ä é ß\u1e9e ǅ İi 12,x", "", " \t\n", "ΑΣ of OF ﬁ 😀#", "the " * 40 + "ſ K THE tHe"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    known = F.array(*map(F.lit, ["the", "of", "k"]))
    words = F.split(F.trim("text"), r"\s+")
    rows = df.select(quality.character_classes(F.col("text")).alias("c"), quality._histogram(words, known).alias("h")).collect()
    assert [r["c"] for r in rows] == [plain_classes(t) for t in texts]
    assert [r["h"][:3] for r in rows][3:] == [[0, 2, 0], [42, 0, 1]]


def js_distance(a, b):
    m, n = sum(a), sum(b)
    if not m or not n:
        return None
    terms = [(x / m, y / n) for x, y in zip(a, b)]
    kl = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(0.0, sum(kl(x, y) + kl(y, x) for x, y in terms) / 2))


def plain_classes(text):
    kinds = Counter()
    for c in text:
        kind = unicodedata.category(c)
        at = 0 if c == " " else 1 if "\x09" <= c <= "\x0d" else {"Lu": 2, "Ll": 3}.get(kind, 7)
        kinds[4 if c in "0123456789" else 5 if c in ".,;:" else 6 if c in "#*$%&|<>" else at] += 1
    return [kinds[k] for k in range(8)]


def plain_verdicts(rows):
    """doc_id: (kept, char_distance, word_distance), with references and words over all rows that pass."""
    passing = [(t, lang) for _, t, lang in rows if not plain(t)[-1]]
    counts = {lang: Counter() for _, _, lang in rows} | {None: Counter()}
    for text, lang in passing:
        found = [w.lower() for w in WORD.findall(text) if w.isalpha()]
        counts[None].update(found)
        if lang:
            counts[lang].update(found)
    top = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:16]] for k, c in counts.items()}

    def word_counts(text, lang):
        words = [w.lower() for w in WORD.findall(text)]
        own = [words.count(w) for w in top[lang]]
        return own + [0] * (16 - len(own)) + [len(words) - sum(own)]

    sums = lambda lists: [sum(x) for x in zip(*lists)]
    languages = {lang for _, lang in passing}
    chars = {x: sums(plain_classes(t) for t, lang in passing if lang == x) for x in languages}
    words = {x: sums(word_counts(t, lang) for t, lang in passing if lang == x) for x in languages}
    out = {}
    for doc, text, lang in rows:
        char = js_distance(plain_classes(text), chars.get(lang, []))
        word = js_distance(word_counts(text, lang), words.get(lang, []))
        n = len(WORD.findall(text))
        far = char is not None and len(text) >= 150 and char > 0.22 + 1.7 / math.sqrt(len(text))
        far = far or word is not None and n >= 30 and word > 0.20 + 1.2 / math.sqrt(n)
        out[doc] = (not plain(text)[-1] and not far, char, word)
    return out


def check_verdicts(spark, rows):
    expected = plain_verdicts(rows)
    got = {r["doc_id"]: r for r in judged(spark, rows)}
    assert sorted(got) == sorted(expected)
    for doc, (kept, *distances) in expected.items():
        assert got[doc]["kept"] == kept
        assert (got[doc]["char_distance"], got[doc]["word_distance"]) == pytest.approx(distances, abs=1e-9)
    return got


def test_common_words_are_of_all_rows_that_pass(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeiourstln", k=rng.randrange(3, 9))) for _ in range(300)]
    rows = [(i, prose(rng, rng.randrange(25, 60), words), "en" if i % 10 else "fr") for i in range(700)]
    rows += [(1000 + i, "spam " * 3000 + " ".join(f"ham{'x' * k}" for k in range(20)), "en") for i in range(3)]
    rows += [(2000 + i, prose(rng, 80, ["não", "mais", "pois", "onde"]), None) for i in range(9)]
    rows += [(3000 + i, " ".join(rng.choices(words, k=200)), "en") for i in range(4)]
    got = check_verdicts(spark, rows)
    assert {r["kept"] for r in got.values()} == {True, False}


def test_every_language_has_its_own_reference(spark):
    rng = random.Random(5)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 20 * k + i) for i in range(20)] if k % 2 else list("aeiourstln")
        words = ["".join(rng.choices(letters, k=rng.randrange(3, 7))) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rng.choices(words, k=80)), f"l{k:02}") for i in range(4 if k < 64 else 3)]
    rows += [(9000, " ".join(map(str, range(90))), "digits"), (9001, "one " * 40, "spam")]
    got = check_verdicts(spark, rows)
    assert all(r["kept"] for d, r in got.items() if d != 9001)


def test_distance(spark):
    pairs = [([3, 1, 0], [1, 1, 2]), ([1, 0], [0, 5]), ([2, 2], [3, 3]), ([0, 0], [1, 2]), ([1, 1], None)]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    got = [r[0] for r in df.select(distance(F.col("a"), F.col("b"))).collect()]
    p, q = (0.75, 0.25, 0), (0.25, 0.25, 0.5)
    kl = lambda x: sum(a * math.log2(a / ((a + b) / 2)) for a, b in zip(*x) if a)
    assert abs(got[0] - math.sqrt((kl((p, q)) + kl((q, p))) / 2)) < 1e-12
    assert got[1] == 1.0 and got[2] == 0.0 and got[3:] == [None, None]


def test_empty(spark):
    assert judged(spark, []) == []
