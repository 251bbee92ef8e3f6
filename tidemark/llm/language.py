"""Language of texts by rank-order profiles of character n-grams.

A profile lists a language's n-grams of one to three characters from the most frequent
down. A text gets the language whose profile its own most frequent n-grams are least out
of place in: each counts by how many ranks apart it stands, or as much as the profile is
long where it is missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tidemark.llm.words import whole_row
from tidemark.plans.staging import stage


UNKNOWN = "und"
PROFILE_GRAMS = 400
TEXT_GRAMS = 300
#: Profiles are made of about so many documents a language, chosen by hash.
SAMPLE_DOCUMENTS = 1000
#: One document in four, by the CRC-32 of its id, is held out from learning.
FOLDS, HELD_OUT_FOLD = 4, 2

SCORED = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lettered", BooleanType())]

LETTERS = re.compile(r"[^\W\d_]+")
BLANK = 32
BITS = np.int64(21)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, as numbers, and how often each occurs.

    Words are runs of letters in lower case with a blank on either side; n-grams have no
    blank in the middle. Shorter n-grams are smaller numbers.
    """
    line = " ".join(LETTERS.findall(text.lower()))
    if not line.replace(" ", "").isalpha():  # numerals that are neither letters nor digits
        line = " ".join("".join(c if c.isalpha() else " " for c in line).split())
    if not line:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {line} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    pairs = (c[:-1] << BITS) | c[1:]
    triples = (pairs[:-1] << BITS) | c[2:]
    grams = [c[c != BLANK], pairs, triples[c[1:-1] != BLANK]]
    return np.unique(np.concatenate(grams), return_counts=True)


def top_grams(text: str) -> np.ndarray:
    """The most frequent n-grams in order; of equally frequent ones the smaller first."""
    grams, counts = gram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:TEXT_GRAMS]]


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out; one without an id is not."""
    fold = F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def _count_sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, grams, counts = [], [], []
        for lang, text in zip(batch.column(0), batch.column(1)):
            some, n = gram_counts(text.as_py())
            langs += [lang.as_py()] * len(some)
            grams.append(some)
            counts.append(n)
        if langs:
            arrays = [pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame) -> dict[str, list[int]]:
    """The most frequent n-grams of every language, in order.

    `docs` has doc_id, lang and text. Rows that are held out, or lack an id, a text or a
    language, are not learned from.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sizes = stage(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = F.least(F.lit(1.0), F.lit(SAMPLE_DOCUMENTS) / F.col("n"))
    modulus = 1 << 30
    sample = known.join(sizes.select("lang", share.alias("share")), "lang").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(modulus)) < F.col("share") * modulus
    )
    counts = sample.where(F.col("text").isNotNull()).select("lang", "text").mapInArrow(_count_sample, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE_GRAMS)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "place").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranks:
    """All profiles as one list of (language, rank), in order of the n-grams."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        sizes = [len(profiles[x]) for x in self.languages]
        grams = np.array([g for x in self.languages for g in profiles[x]], np.int64)
        order = np.argsort(grams, kind="stable")
        self.of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.ranks = np.array([k for n in sizes for k in range(n)], np.int32)[order]
        self.grams, counts = np.unique(grams, return_counts=True)
        self.starts = np.concatenate([[0], np.cumsum(counts)])

    def closest(self, text: str | None) -> tuple[str, float, bool]:
        """Language and score, one less the distance as a share of the largest possible one, and whether there are letters."""
        own = top_grams(text) if text else ()
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0, len(own) > 0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        places = np.flatnonzero(self.grams[at] == own)
        first = self.starts[at[places]]
        sizes = self.starts[at[places] + 1] - first
        entries = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        nearer = PROFILE_GRAMS - np.abs(self.ranks[entries] - np.repeat(places, sizes))
        distances = len(own) * PROFILE_GRAMS - np.bincount(self.of[entries], nearer, len(self.languages))
        best = int(distances.argmin())
        return self.languages[best], 1.0 - float(distances[best]) / (len(own) * PROFILE_GRAMS), True


def _with_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(row, lang_pred, score, lettered): all columns of a row, its language and score, and whether it has letters."""
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(learn_profiles(narrow))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(shared.value)
        for batch in batches:
            rows = batch.column(0)
            found = [ranks.closest(text.as_py()) for text in rows.field(text_col).cast(pa.string())]
            languages, scores, lettered = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(lettered, pa.bool_())],
                ["row", "lang_pred", "score", "lettered"],
            )

    rows = docs.select(whole_row(docs))
    return rows.mapInArrow(predict, StructType([*rows.schema, *SCORED]))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs`.

    Predictions use the whole text and nothing else; equally close languages give the
    first in order. `lang_pred` is `und`, with score 0, where the text is null or has no
    letter, or where no language could be learned. Null ids and repeated rows are kept;
    other columns are not read; an empty table gives no rows.
    """
    narrow = docs.select(id_col, text_col, lang_col)
    found = _with_languages(narrow, id_col, text_col, lang_col)
    doc_id = F.col("row")[id_col].cast("long")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score")


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.0
) -> DataFrame:
    """The rows of `docs`, with all columns, whose text is in a language: it has letters, and is scored so high.

    Rejected are texts that are null or without letters, and with `least_score` those that
    no learned language is near to. Where no row has a language to learn from, all texts
    with letters stay, as nothing can be said against them.
    """
    found = _with_languages(docs, id_col, text_col, lang_col)
    unlearned = F.col("lang_pred") == UNKNOWN
    return found.where(F.col("lettered") & (unlearned | (F.col("score") >= least_score))).select("row.*")
