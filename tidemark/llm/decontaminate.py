"""Benchmark passages in documents, by a prefix-filtered join on shingles.

An item's windows of 13 words are sets of word shingles. A document contains a window
only if it contains all of its shingles, so one of them, the rarest in the corpus, is
the necessary prefix: windows are joined to documents on that shingle alone. Where it
stands fixes where the window would begin, which has to lie within the document, and
there the words are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.words import whole_row
from tidemark.plans.staging import stage

WINDOW_WORDS = 13
SHINGLE_WORDS = 5
#: A document is contaminated if one word in so many is hit.
LEAST_SHARE = 20
#: What a window around a shingle can cover: words before it, and from it on.
BEFORE, FROM = WINDOW_WORDS - 1, WINDOW_WORDS
#: Shingles found in a stretch of a document that is kept as one list of words.
REGION_PLACES = 64
#: The filter sent to all tasks has 32 bits a shingle, and 16 MB at most.
BITS_PER_SHINGLE = 32
FILTER_BITS = (16, 27)

# The rule's words after A-Z are lowered, on UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)

REGION = "start int, words array<string>, at array<int>, shingles array<long>"


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; runs of other sizes hash differently."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ hashes[i : i + n]) * MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


def filter_bits(shingles: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions for each shingle."""
    shift = np.uint64(64 - bits)
    return shingles >> shift, (shingles * STEP) >> shift


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, window, size, shingles) of each window of each item."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            words = words_of(text.as_py())
            size = min(WINDOW_WORDS, len(words))
            shingles = shingle_hashes(word_hashes(words), min(SHINGLE_WORDS, size)).view(np.int64).tolist()
            per_window = size - min(SHINGLE_WORDS, size) + 1
            for i in range(len(words) - size + 1 if words else 0):
                window = b" ".join(words[i : i + size]).decode()
                rows.append((item, window, size, shingles[i : i + per_window]))
        items, windows, sizes, shingles = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(items, pa.string()),
                pa.array(windows, pa.string()),
                pa.array(sizes, pa.int32()),
                pa.array(shingles, pa.list_(pa.int64())),
            ],
            ["item_id", "window", "size", "shingles"],
        )


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    narrow = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_windows, "item_id string, window string, size int, shingles array<long>")


def shingle_filter(windows: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """A bit set of all shingles of the windows, its size as a power of two, and the shingles' sizes.

    Its words of 64 bits are put together by the tasks; at most 2 ** 21 of them come back.
    """
    counted = windows.agg(
        F.sum(F.size("shingles")).alias("n"),
        F.collect_set(F.least("size", F.lit(SHINGLE_WORDS))).alias("sizes"),
    ).first()
    wanted = max(1, (counted["n"] or 0) * BITS_PER_SHINGLE).bit_length()
    bits = min(max(wanted, FILTER_BITS[0]), FILTER_BITS[1])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = np.asarray(batch.column(0).flatten()).astype(np.int64).view(np.uint64)
            places = np.unique(np.concatenate(filter_bits(shingles, bits)))
            masks = np.uint64(1) << (places & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array(masks.view(np.int64))],
                ["word", "mask"],
            )

    parts = windows.select("shingles").mapInArrow(partial, "word long, mask long")
    merged = parts.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[np.asarray(merged["word"])] = np.asarray(merged["mask"]).astype(np.int64).view(np.uint64)
    return table, bits, sorted(counted["sizes"])


def _regions(words: list[bytes], places: np.ndarray, shingles: np.ndarray) -> list[dict]:
    """The stretches of a document that windows around the found shingles could cover.

    A stretch ends where the next shingle is far, or after REGION_PLACES of them: those
    that follow are in another stretch, which begins with the words they need.
    """
    found, begin = [], 0
    far = np.append(np.diff(places) > BEFORE + FROM, True)
    while begin < len(places):
        gaps = np.flatnonzero(far[begin : begin + REGION_PLACES])
        stop = begin + (int(gaps[0]) + 1 if len(gaps) else REGION_PLACES)
        at, which = places[begin:stop], shingles[begin:stop]
        begin = stop
        start = max(0, int(at[0]) - BEFORE)
        part = words[start : int(at[-1]) + FROM]
        found.append(
            {
                "start": start,
                "words": [w.decode() for w in part],
                "at": at.tolist(),
                "shingles": which.view(np.int64).tolist(),
            }
        )
    return found


def scan_documents(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, content, n_words, regions) for every row, each text read once.

    `content` is a hash of the text, by which rows are told apart where ids are null
    or repeated. `regions` hold whatever the filter takes for a shingle of a window.
    """
    spark = docs.sparkSession
    table, bits, sizes = shingle_filter(windows)
    shared = spark.sparkContext.broadcast(table)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value

        def has(places: np.ndarray) -> np.ndarray:
            return (table[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            counts, regions = [], []
            for text in batch.column(2).cast(pa.binary()):
                words = words_of(text.as_py())
                hashes = word_hashes(words)
                counts.append(len(words))
                at, which = [], []
                for size in sizes:
                    shingles = shingle_hashes(hashes, size)
                    one, other = filter_bits(shingles, bits)
                    hits = np.flatnonzero(has(one))
                    hits = hits[has(other[hits])]
                    at.append(hits)
                    which.append(shingles[hits])
                if any(map(len, at)):
                    at, which = np.concatenate(at), np.concatenate(which)
                    order = np.argsort(at, kind="stable")
                    regions.append(_regions(words, at[order], which[order]))
                else:
                    regions.append([])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts, pa.int64()),
                    pa.array(
                        regions,
                        pa.list_(
                            pa.struct(
                                [
                                    ("start", pa.int32()),
                                    ("words", pa.list_(pa.string())),
                                    ("at", pa.list_(pa.int32())),
                                    ("shingles", pa.list_(pa.int64())),
                                ]
                            )
                        ),
                    ),
                ],
                ["doc_id", "content", "n_words", "regions"],
            )

    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("content"),
        F.col(text_col).cast("string").alias("text"),
    )
    return narrow.mapInArrow(scan, f"doc_id long, content long, n_words long, regions array<struct<{REGION}>>")


def places_found(scanned: DataFrame) -> DataFrame:
    """(doc_id, content, place, shingle, start, words): each shingle found, with the words from `start` on.

    They are those that a window around the shingle can cover, BEFORE + FROM at most, so
    that a row is as wide in a long stretch of hits as anywhere.
    """
    regions = scanned.select("doc_id", "content", F.inline("regions"))
    each = regions.select(
        "doc_id",
        "content",
        F.col("start").alias("region_start"),
        F.col("words").alias("region"),
        F.inline(F.arrays_zip("at", F.col("shingles").alias("shingle"))).alias("place", "shingle"),
    )
    start = F.greatest(F.col("place") - BEFORE, F.col("region_start"))
    near = F.slice("region", start - F.col("region_start") + 1, F.col("place") + FROM - start)
    return each.select("doc_id", "content", "place", "shingle", start.alias("start"), near.alias("words"))


def prefixes(windows: DataFrame, found: DataFrame) -> DataFrame:
    """(shingle, offset, window, size): the rarest shingle of each window.

    A window with a shingle that no document has is left out.
    """
    counts = found.groupBy("shingle").agg(F.count("*").alias("n"))
    parts = windows.select("window", "size", "shingles").dropDuplicates(["window"])
    parts = parts.select("window", "size", F.posexplode("shingles").alias("offset", "shingle"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    chosen = parts.join(counts, "shingle", "left").groupBy("window", "size").agg(rarest)
    return chosen.where(F.col("rarest.n") > 0).select("rarest.shingle", "rarest.offset", "window", "size")


def _covered(spans: Column) -> Column:
    """Words in a sorted list of (begin, size), each counted once."""
    end = lambda span: span["begin"] + span["size"]
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto")),
        lambda so_far, span: F.struct(
            (
                so_far["words"]
                + F.greatest(F.lit(0), end(span) - F.greatest(so_far["upto"], span["begin"]))
            ).alias("words"),
            F.greatest(so_far["upto"], end(span)).alias("upto"),
        ),
        lambda so_far: so_far["words"],
    )


def find_benchmark_passages(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, content, n_words, n_hit, item_ids, contaminated) for every row of `docs`.

    A word is hit if it lies in any occurrence of a window: 13 consecutive words of an
    item, or all words of a shorter one. `item_ids` are the items with such windows, as
    sorted strings. Null and empty texts have no words; an item without an id hits words
    and is not listed; an id that repeats stands for all of its texts. Repeated rows are
    kept, each with the same result; other columns are not read. Empty tables on either
    side give rows without hits, or no rows.
    """
    windows = stage(item_windows(items, item_col, item_text_col), "windows")
    scanned = stage(scan_documents(docs, windows, id_col, text_col), "scanned")
    found = places_found(scanned)
    index = stage(prefixes(windows, found), "prefixes")
    begin = F.col("place") - F.col("offset")
    first, size = begin - F.col("start"), F.col("size")
    met = found.join(index, "shingle").where((first >= 0) & (first + size <= F.size("words")))
    met = met.where(F.array_join(F.slice("words", first + 1, size), " ") == F.col("window"))
    met = stage(met.select("doc_id", "content", begin.alias("begin"), "size", "window").distinct(), "met")

    spans = met.groupBy("doc_id", "content").agg(
        _covered(F.array_sort(F.collect_set(F.struct("begin", "size")))).alias("n_hit")
    )
    named = met.select("doc_id", "content", "window").distinct().join(
        windows.select("item_id", "window").distinct(), "window"
    )
    named = named.groupBy("doc_id", "content").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hit = spans.alias("s").join(
        named.alias("i"),
        F.expr("s.doc_id <=> i.doc_id and s.content = i.content"),
        "left",
    ).select("s.doc_id", "s.content", "n_hit", "item_ids")
    result = scanned.select("doc_id", "content", "n_words").alias("d").join(
        hit.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.content = h.content"), "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return result.select(
        "d.doc_id",
        "d.content",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (LEAST_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of `docs`, with all columns, that are not contaminated."""
    found = find_benchmark_passages(docs, items, id_col, text_col, item_col, item_text_col)
    bad = stage(found.where("contaminated").select("doc_id", "content").distinct(), "contaminated")
    whole = docs.select(
        whole_row(docs),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("content"),
    )
    same = F.expr("d.doc_id <=> b.doc_id and d.content = b.content")
    return whole.alias("d").join(bad.alias("b"), same, "left_anti").select("row.*")
