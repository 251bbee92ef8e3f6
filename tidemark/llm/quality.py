"""Quality of texts by how far their histograms are from those of their language.

Two histograms are compared, of character classes and of a language's common words, by
Jensen-Shannon distance (the root of the divergence, base 2). Spark expressions only.

Texts are read twice: for the common words of all languages, over the texts that pass the
base rules, and for the counts and histograms of each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import WORD, let
from tidemark.plans.staging import stage

SYMBOLS = "[#*$%&|<>]"
REPEAT_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

#: Common words of a language.
COMMON_WORDS = 16
#: Shorter texts are not judged by the histogram.
LEAST_JUDGED_CHARS = 150
LEAST_JUDGED_WORDS = 30
#: A histogram is too far beyond limit + chance / sqrt(its size). Short texts are far by chance.
CHAR_LIMIT, CHAR_CHANCE = 0.22, 1.7
WORD_LIMIT, WORD_CHANCE = 0.20, 1.2


def _base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def common_words(docs: DataFrame) -> DataFrame:
    """(language, vocabulary): the most frequent words of letters, in order, of each language.

    They are counted over all documents that pass the base rules; under "", for rows of
    null language, over those of all languages together. Where no word is found there is
    no row.
    """
    passing = lambda words: F.when(
        ~_base_failed(F.size(words).cast("long"), repeated_words(words).cast("long")), words
    )
    found = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), passing)
    words = docs.select("lang", F.explode(found).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # Each different word is looked at once.
    words = words.where(F.rlike("word", F.lit(r"^\p{L}+$"))).withColumn("word", F.lower("word"))
    counts = words.select(F.explode(F.array("lang", F.lit(""))).alias("language"), "word", "n")
    counts = counts.where(F.col("language").isNotNull()).groupBy("language", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("language").orderBy(F.desc("n"), "word")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= COMMON_WORDS)
    listed = F.sort_array(F.collect_list(F.struct("place", "word")))["word"]
    return top.groupBy("language").agg(listed.alias("vocabulary"))


CLASSES = ("space", "break", "upper", "lower", "digit", "stop", "symbol", "other")


def character_classes(text: Column) -> Column:
    """Characters of each class, in the order of CLASSES.

    Most characters are lower case letters and spaces. What is left without them is short,
    so that the other classes are looked for there.
    """
    size = F.length(text)
    parts = F.struct(
        size.alias("size"),
        (size - F.length(F.replace(text, F.lit(" "), F.lit("")))).alias("space"),
        F.regexp_replace(text, r"[\p{Ll} ]+", "").alias("rest"),
    )

    def counts(of: Column) -> Column:
        count = lambda pattern: F.regexp_count(of["rest"], F.lit(pattern))
        lower = of["size"] - F.length(of["rest"]) - of["space"]
        known = [
            of["space"], count(r"[\x09-\x0D]"), count(r"\p{Lu}"), lower, count("[0-9]"), count("[.,;:]"), count(SYMBOLS)
        ]
        total = lambda all_of: F.aggregate(all_of, F.lit(0), lambda a, b: a + b)
        whole = lambda found: F.concat(found, F.array(of["size"] - total(found)))
        return let(F.array(*known), whole).cast("array<bigint>")

    return let(parts, counts)


def _covered(windows: Column) -> Column:
    """Words in windows, given by their hashes in order, that occur twice or more."""

    def places(by_hash: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(by_hash, k)["hash"] == x["hash"], F.lit(False))
        marked = F.transform(by_hash, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["at"]))
        return F.sort_array(F.filter(marked, lambda at: at.isNotNull()))

    def total(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto")),
            lambda done, i: F.struct(
                (done["words"] + i + REPEAT_WORDS - F.greatest(done["upto"], i)).alias("words"),
                (i + REPEAT_WORDS).alias("upto"),
            ),
            lambda done: done["words"],
        )

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    return let(pairs, lambda by_hash: total(places(by_hash)))


def repeated_words(words: Column) -> Column:
    """Words in windows of REPEAT_WORDS words that are found twice or more in the text.

    A window's hash is made from those of its halves.
    """

    def joined(hashes: Column, step: int) -> Column:
        """Of each place, the hash of what is there and what is `step` places later."""
        size = F.greatest(F.size(hashes) - step, F.lit(0))
        return F.zip_with(F.slice(hashes, 1, size), F.slice(hashes, step + 1, size), lambda a, b: F.xxhash64(a, b))

    def windows(fours: Column) -> Column:
        eights = joined(fours, REPEAT_WORDS // 2)
        again = lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), _covered(found)).otherwise(0)
        # A window that is found again has five runs of four words that are.
        some = F.size(F.array_distinct(fours)) + REPEAT_WORDS // 2 < F.size(fours)
        return F.when(some, let(eights, again)).otherwise(0)

    def count(hashes: Column) -> Column:
        fours = let(joined(hashes, 1), lambda twos: joined(twos, 2))
        return F.when(F.size(hashes) > REPEAT_WORDS, let(fours, windows)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def _histogram(words: Column, vocabulary: Column) -> Column:
    """How often each word of the vocabulary occurs, and last all others."""

    def counts(places: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(1), F.lit(COMMON_WORDS)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("long")
        )
        return F.concat(each, F.array((F.size(words) - F.size(places)).cast("long")))

    def places(of: Column) -> Column:
        # Common words are short; longer ones need not be looked up, as lower case takes no characters away.
        place = lambda w: F.array_position(of["known"], F.lower(w)).cast("int")
        found = F.transform(F.filter(words, lambda w: F.length(w) <= of["longest"]), place)
        return F.filter(found, lambda p: p > 0)

    longest = F.array_max(F.transform(vocabulary, F.length))
    known = F.struct(vocabulary.alias("known"), F.coalesce(longest, F.lit(0)).alias("longest"))
    return let(known, lambda of: let(places(of), counts))


def measure(docs: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """The counts and histograms of each row."""
    known = docs.withColumn("language", F.coalesce("lang", F.lit(""))).join(vocabularies, "language", "left")
    chosen = F.coalesce("vocabulary", F.array().cast("array<string>"))
    text = F.col("text")
    from_words = lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        _histogram(words, chosen).alias("word_counts"),
    )
    found = known.select(
        "doc_id",
        "language",
        F.length(text).cast("long").alias("chars"),
        character_classes(text).alias("char_counts"),
        repeated_lines(text).cast("long").alias("n_dup_lines"),
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), from_words).alias("w"),
    )
    in_class = lambda name: F.col("char_counts")[CLASSES.index(name)]
    return found.select(
        "doc_id",
        "language",
        "chars",
        "w.*",
        (F.col("chars") - in_class("space") - in_class("break")).alias("word_chars"),
        in_class("symbol").alias("n_symbols"),
        "n_dup_lines",
        "char_counts",
        _base_failed(F.col("w.n_words"), F.col("w.n_repeat_words")).alias("base_failed"),
    )


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null where one of them is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    def divergence(of: Column) -> Column:
        terms = F.zip_with(
            counts, reference, lambda a, b: part(a / of["own"], b / of["ref"]) + part(b / of["ref"], a / of["own"])
        )
        return F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))

    totals = F.struct(total(counts).alias("own"), total(reference).alias("ref"))
    return let(totals, lambda of: F.when((of["own"] > 0) & (of["ref"] > 0), divergence(of)))


def _sums(column: str, size: int) -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in range(size)))


def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Counts, distances and verdict, `kept`, for every row of `docs`.

    A row fails the base rules (`base_failed`) with fewer than LEAST_WORDS words or with
    more than MOST_REPEATED in 100 words inside repeated windows. References are summed
    over all rows of a language that do not. A row is kept if it does not fail and
    neither histogram, where the text is long enough for it, is too far from the
    reference. Rows of null language are compared with each other. Null texts are empty;
    null ids and repeated rows are kept; other columns are not read. An empty table gives
    no rows.
    """
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.nullif(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    measured = stage(measure(narrow, stage(common_words(narrow), "words")), "quality")
    references = (
        measured.where(~F.col("base_failed"))
        .groupBy("language")
        .agg(_sums("char_counts", 8).alias("ref_chars"), _sums("word_counts", COMMON_WORDS + 1).alias("ref_words"))
    )
    compared = measured.join(references, "language", "left").withColumns(
        {
            "char_distance": distance(F.col("char_counts"), F.col("ref_chars")),
            "word_distance": distance(F.col("word_counts"), F.col("ref_words")),
        }
    )
    far = lambda column, size, least, limit, chance: F.coalesce(
        (F.col(size) >= least) & (F.col(column) > limit + chance / F.sqrt(size)), F.lit(False)
    )
    far_chars = far("char_distance", "chars", LEAST_JUDGED_CHARS, CHAR_LIMIT, CHAR_CHANCE)
    far_words = far("word_distance", "n_words", LEAST_JUDGED_WORDS, WORD_LIMIT, WORD_CHANCE)
    return compared.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~far_chars & ~far_words).alias("kept"),
        "char_distance",
        "word_distance",
    )
