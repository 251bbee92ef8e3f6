"""Documents drawn by how much their word runs look like those of a target corpus.

Features are runs of one to three words, each in the bucket that its CRC-32 names. What a
run adds to a CRC follows from the CRC before it, the length of what is appended and the
CRC of that alone, so that runs are hashed from the states of their words without joining
their bytes. The vocabulary has a head and a tail. Head words, the most frequent of all
documents, are sent to the tasks with their CRC states, and of pairs of the most frequent
ones those that occur most often with their buckets. All other features take the CRC of
their own bytes. Both make exact totals: the head's are counted by word and pair and laid
into buckets at the end, the tail's are counted by bucket at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import WORD
from tidemark.plans.staging import stage

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
DRAWN_PERCENT = 5

#: Words of the head, those of them whose pairs are counted, and the pairs that are sent.
HEAD_WORDS, PAIRED_WORDS, HEAD_PAIRS = 4096, 512, 1 << 16
#: Longer words are never in the head, and are hashed byte by byte.
LONGEST = 64
#: Bytes of a text that are split into words at a time, and words hashed together, about.
PIECE_BYTES, BLOCK_WORDS = 1 << 20, 1 << 16

POLYNOMIAL = 0xEDB88320
SPACE = zlib.crc32(b" ")


def _shifts() -> np.ndarray:
    """What CRCs become when 0 to LONGEST + 1 bytes follow: by number, place of a byte and its value."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    value = np.arange(256, dtype=np.uint32)
    after = [np.stack([value << np.uint32(8 * k) for k in range(4)])]
    for _ in range(LONGEST + 1):
        after.append(step[after[-1] & 255] ^ (after[-1] >> np.uint32(8)))
    return np.stack(after)


SHIFTS = _shifts()


def shifted(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """CRCs of texts, without what `count` bytes behind each add themselves."""
    out = SHIFTS[count, 0, crc & 255]
    for k in range(1, 4):
        out ^= SHIFTS[count, k, (crc >> np.uint32(8 * k)) & 255]
    return out


#: CRCs of a space before a word, less the word's own, by the word's length.
AFTER_SPACE = shifted(np.full(LONGEST + 1, SPACE, np.uint32), np.arange(LONGEST + 1))


class Head(NamedTuple):
    """The words sent to all tasks, most frequent first, and pairs of the first ones."""

    words: list[bytes]
    pair_states: np.ndarray
    pair_buckets: np.ndarray
    """Of pair a * PAIRED_WORDS + b; -1 where the pair is not in the head."""


class Words(NamedTuple):
    """Words of several texts, with which of them begin what."""

    ids: np.ndarray
    """Place in the head, -1 in the tail."""
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    """CRC states of the runs that end at each word."""
    pairs: np.ndarray
    """Pair of head words that ends here, -1 if none."""
    fresh: np.ndarray
    depth: np.ndarray
    """Words of the same text before this one, two at most."""
    owner: np.ndarray


def pieces(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of a lower-cased text some at a time, and how many of the first were there before."""
    start, before = 0, []
    while start < len(text) or start == 0:
        stop = start + PIECE_BYTES
        if stop < len(text):
            # A piece ends behind a word's end, so that no word is cut.
            word = WORD.match(text, stop)
            stop = word.end() if word else stop
        words = WORD.findall(text, start, stop)
        yield before + words, len(before)
        before = (before + words)[-2:]
        start = max(stop, 1)


class Hasher:
    """Hashes texts in blocks of words, with a head that is the same for all."""

    def __init__(self, head: Head):
        self.head = head
        self.places = {w: i for i, w in enumerate(head.words)}
        self.states = np.array([*map(zlib.crc32, head.words), 0], np.uint32)
        self.lengths = np.array([*map(len, head.words), 0], np.int64)
        self.words: list[bytes] = []
        self.parts: list[tuple[int, int, int]] = []

    def blocks(self, texts: Iterable[bytes | None]) -> Iterator[Words]:
        for row, text in enumerate(texts):
            for words, before in pieces((text or b"").lower()):
                self.words += words
                self.parts.append((row, len(words), before))
                if len(self.words) >= BLOCK_WORDS:
                    yield self._hashed()
        if self.words:
            yield self._hashed()
        self.words, self.parts = [], []

    def _hashed(self) -> Words:
        words, n = self.words, len(self.words)
        rows, sizes, before = (np.array(c, np.int64) for c in zip(*self.parts))
        self.words, self.parts = [], []
        inside = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        depth, fresh = np.minimum(inside, 2), inside >= np.repeat(before, sizes)

        ids = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, n)
        one, lengths = self.states[ids], self.lengths[ids]
        tail = np.flatnonzero(ids < 0)
        one[tail] = np.fromiter((zlib.crc32(words[i]) for i in tail), np.uint32, len(tail))
        lengths[tail] = np.fromiter((len(words[i]) for i in tail), np.int64, len(tail))
        long = np.flatnonzero(lengths > LONGEST)
        short = np.minimum(lengths, LONGEST)
        alone = AFTER_SPACE[short] ^ one

        pairs = np.full(n, -1, np.int64)
        paired = (ids[1:] >= 0) & (ids[1:] < PAIRED_WORDS) & (ids[:-1] >= 0) & (ids[:-1] < PAIRED_WORDS)
        both = np.flatnonzero(paired & (depth[1:] > 0)) + 1
        pairs[both] = ids[both - 1] * PAIRED_WORDS + ids[both]
        known = np.zeros(n, bool)
        known[both] = self.head.pair_buckets[pairs[both]] >= 0

        two = np.zeros(n, np.uint32)
        two[known] = self.head.pair_states[pairs[known]]
        rest = np.flatnonzero(~known[1:]) + 1
        two[rest] = shifted(one[rest - 1], short[rest] + 1) ^ alone[rest]
        for i in long[long > 0].tolist():
            two[i] = zlib.crc32(words[i], zlib.crc32(b" ", int(one[i - 1])))
        three = np.zeros(n, np.uint32)
        three[1:] = shifted(two[:-1], short[1:] + 1) ^ alone[1:]
        for i in long[long > 1].tolist():
            three[i] = zlib.crc32(words[i], zlib.crc32(b" ", int(two[i - 1])))
        return Words(ids, one, two, three, pairs, fresh, depth, np.repeat(rows, sizes))


def _narrow(docs: DataFrame, text_col: str) -> Column:
    return F.col(text_col).cast("string").alias("text")


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[bytes] = Counter()
        for text in batch.column(0).cast(pa.binary()):
            for words, before in pieces((text.as_py() or b"").lower()):
                counts.update(words[before:])
        kept = [w for w in counts if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.binary()), pa.array([counts[w] for w in kept], pa.int64())], ["word", "n"]
        )


def head_words(docs: DataFrame, text_col: str = "text") -> list[bytes]:
    """The HEAD_WORDS words that all documents have most often, of LONGEST bytes at most each."""
    counts = docs.select(_narrow(docs, text_col)).mapInArrow(_word_counts, "word binary, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).collect()]


def head_without_pairs(words: list[bytes]) -> Head:
    size = PAIRED_WORDS**2
    return Head(words, np.zeros(size, np.uint32), np.full(size, -1, np.int32))


def feature_counts(docs: DataFrame, head: Head, text_col: str = "text") -> DataFrame:
    """(pair, bucket, n): features of all rows by bucket, those of pairs of head words by pair too.

    `pair` is -1 for all other features. A task returns BUCKETS rows and one for each
    pair of head words at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shared.value)
        of_word = np.zeros(len(hasher.places), np.int64)
        of_pair = np.zeros(PAIRED_WORDS**2, np.int64)
        totals = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = (t.as_py() for t in batch.column(0).cast(pa.binary()))
            for w in hasher.blocks(texts):
                headed = w.ids >= 0
                of_word += np.bincount(w.ids[w.fresh & headed], minlength=len(of_word))
                paired = w.pairs >= 0
                of_pair += np.bincount(w.pairs[w.fresh & paired], minlength=len(of_pair))
                for states, ends in (
                    (w.one, w.fresh & ~headed),
                    (w.two, w.fresh & (w.depth > 0) & ~paired),
                    (w.three, w.fresh & (w.depth > 1)),
                ):
                    totals += np.bincount(states[ends] % BUCKETS, minlength=BUCKETS)
        states = hasher.states[:-1]
        totals += np.bincount(states % BUCKETS, weights=of_word, minlength=BUCKETS).astype(np.int64)
        met, filled = np.flatnonzero(of_pair), np.flatnonzero(totals)
        first, second = met // PAIRED_WORDS, met % PAIRED_WORDS
        joined = shifted(states[first], hasher.lengths[second] + 1) ^ AFTER_SPACE[hasher.lengths[second]] ^ states[second]
        columns = (
            np.concatenate([met, np.full(len(filled), -1)]),
            np.concatenate([joined % BUCKETS, filled]).astype(np.int64),
            np.concatenate([of_pair[met], totals[filled]]),
        )
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pair", "bucket", "n"])

    counted = docs.select(_narrow(docs, text_col)).mapInArrow(count, "pair long, bucket long, n long")
    return counted.groupBy("pair", "bucket").agg(F.sum("n").alias("n"))


def with_pairs(words: list[bytes], counted: DataFrame) -> Head:
    """The head with the HEAD_PAIRS most frequent of its pairs."""
    head = head_without_pairs(words)
    chosen = counted.where("pair >= 0").orderBy(F.desc("n"), "pair").limit(HEAD_PAIRS).select("pair").collect()
    for (pair,) in chosen:
        state = zlib.crc32(words[pair // PAIRED_WORDS] + b" " + words[pair % PAIRED_WORDS])
        head.pair_states[pair] = state
        head.pair_buckets[pair] = state % BUCKETS
    return head


def bucket_gains(counted: DataFrame, target: DataFrame) -> np.ndarray:
    """How much a feature of each bucket speaks for the target: 1000 times a smoothed log ratio, down to whole."""
    by_bucket = lambda df, name: df.groupBy("bucket").agg(F.sum("n").cast("double").alias(name))
    s, t = by_bucket(counted, "s"), by_bucket(target, "t")
    all_s, all_t = (df.agg(F.coalesce(F.sum(df.columns[1]), F.lit(0.0))).first()[0] for df in (s, t))
    every = counted.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    met = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0.0, ["s", "t"])
    ratio = (F.col("t") + 1) * F.lit(all_s + BUCKETS) / ((F.col("s") + 1) * F.lit(all_t + BUCKETS))
    rows = met.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    gains = np.zeros(BUCKETS, np.int64)
    for bucket, gain in rows:
        gains[bucket] = gain
    return gains


def weigh(docs: DataFrame, head: Head, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row: the gains of its features, summed."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gains))

    def weights(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gains = shared.value
        hasher = Hasher(head)
        for batch in batches:
            words, total = np.zeros((2, batch.num_rows), np.int64)
            texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
            for w in hasher.blocks(texts):
                known = w.pairs >= 0
                known[known] = head.pair_buckets[w.pairs[known]] >= 0
                buckets = (w.two % BUCKETS).astype(np.int64)
                buckets[known] = head.pair_buckets[w.pairs[known]]
                gain = gains[w.one % BUCKETS]
                gain += np.where(w.depth > 0, gains[buckets], 0)
                gain += np.where(w.depth > 1, gains[w.three % BUCKETS], 0)
                gain[~w.fresh] = 0
                begins = np.flatnonzero(np.diff(w.owner, prepend=-1))
                rows = w.owner[begins]
                total[rows] += np.add.reduceat(gain, begins)
                words[rows] += np.add.reduceat(w.fresh.astype(np.int64), begins)
            features = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (words, features, total))], ["doc_id", "n_words", "n_features", "weight"]
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), _narrow(docs, text_col))
    return narrow.mapInArrow(weights, "doc_id long, n_words long, n_features long, weight long")


def _noise(doc_id: Column) -> Column:
    """1000 times a Gumbel variate, down to whole, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(2.0**32))))


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with `place`, the position of each row from 1 on, without one task for all.

    Rows are sorted by range and written; what lies before a range is the sum of the sizes
    of those before it, one row each.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = stage(ordered.withColumns({"part": F.spark_partition_id(), "within": low}), "ordered")
    sizes = parts.groupBy("part").agg(F.count("*").alias("size")).collect()
    before, upto = {}, 0
    for part, size in sorted(map(tuple, sizes)):
        before[part] = upto
        upto += size
    listed = df.sparkSession.createDataFrame(sorted(before.items()), "part int, before long")
    placed = parts.join(listed, "part").withColumn("place", F.col("before") + F.col("within") + 1)
    return placed.drop("part", "within", "before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of `docs`.

    `weight` is the sum over a row's features, runs of one to three words with repeats, of
    how much more often their bucket is met in `target` than in `docs`. `score` adds noise
    that depends on the id alone, so that taking the highest scores draws without
    replacement in proportion to the weights. Of the rows with LEAST_WORDS words, the
    DRAWN_PERCENT percent with the highest scores are drawn and have a `rank`, from 1; the
    smaller id comes first of equal scores, null last.

    Null texts have no words, weight 0 and no rank; a null id has the noise of an empty
    one. Repeated rows are separate rows, with ranks of their own. Other columns are not
    read. An empty `docs` gives no rows; an empty `target` is one without features. Texts
    are read three times: for the head, for the totals and for the weights.
    """
    words = head_words(docs, text_col)
    plain = head_without_pairs(words)
    counted = stage(feature_counts(docs, plain, text_col), "features")
    wanted = stage(feature_counts(target, plain, target_text_col), "target")
    gains = bucket_gains(counted, wanted)
    weighed = weigh(docs, with_pairs(words, counted), gains, id_col, text_col)
    eligible = F.col("n_words") >= LEAST_WORDS
    scored = stage(weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"))), "scored")
    drawn = scored.where(eligible).count() * DRAWN_PERCENT // 100
    # The number of the row tells equal rows apart, so that many of them do not share a range.
    numbered = scored.withColumn("nth", F.monotonically_increasing_id())
    placed = in_order(
        numbered,
        eligible.desc(),
        F.desc("score"),
        F.col("doc_id").asc_nulls_last(),
        F.col("nth").asc(),
    )
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
