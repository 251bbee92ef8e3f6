"""Passages that occur again, by longest-previous-factor arrays over the parts of texts that can repeat.

A position is repeated if the 400 bytes from it on also start elsewhere: if its longest
previous factor, or its longest next one, has 400 bytes.

Each start is given to an anchor, the 200 bytes with the least hash among those inside
its 400. Equal 400 bytes have equal anchors at equal distances, so suffixes are compared
only within an anchor, and starts of an anchor that occurs once are done. The starts of
one anchor in a text, with the bytes they cover, are a piece. Where all pieces of an anchor
are equal, every start of it is repeated. Where they differ, they are laid below each
other with their anchors in one column, so that suffixes equally far ahead of the anchor
begin in one column too. From the order of the suffixes of one column follows, by the byte
before them, that of the column to its left, and so do the common prefixes of neighbours.
In each order, the nearest suffixes before and after a start whose positions are smaller
have the longest prefix in common with it of all that stand earlier: its longest previous
factor. Those with larger positions give the longest next one.

A hot anchor's suffixes are dealt out by a hash of their 400 bytes, as what has a factor
of that length has it with others of the same hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

LENGTH = 400
ANCHOR = 200
#: Anchors that fit into LENGTH bytes.
WIDTH = LENGTH - ANCHOR + 1
#: Starts that are hashed at a time.
CHUNK = 1 << 17
#: Bits that hold a position within the starts of a chunk and its last window.
PLACE_BITS = np.uint64((1 << 18) - 1)
#: Different pieces of an anchor that are brought together, with at most 599 bytes each.
#: An anchor with more is split: its suffixes go to buckets by the hash of their 400 bytes.
BUCKET_PIECES = 1 << 15
#: Pieces that are laid below each other at a time, of one anchor or several.
LAID = 1 << 12

BASE = 0x9E3779B97F4A7C15
POWERS = np.full(CHUNK + LENGTH, BASE, np.uint64)
POWERS[0] = 1
POWERS = np.cumprod(POWERS)
INVERSES = np.full(CHUNK + LENGTH, pow(BASE, -1, 2**64), np.uint64)
INVERSES[0] = 1
INVERSES = np.cumprod(INVERSES)

ROW = ["doc_id", "key", "key2"]
PIECE = ["anchor", "piece", "n", "at", "peers", "lead", "body"]


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position on."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[: len(data)], out=sums[1:])
    n = len(data) - ANCHOR + 1
    hashes = (sums[ANCHOR:] - sums[:-ANCHOR]) * INVERSES[:n]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


def least_places(hashes: np.ndarray) -> np.ndarray:
    """Where the least of WIDTH hashes from each position on is, the first of equal ones.

    Hashes are compared without their last bits, which hold the position instead. A window
    of WIDTH is the end of one block of that size and the beginning of the next, so that its
    least one follows from the running minima of both.
    """
    n = len(hashes)
    keys = np.full(-(-n // WIDTH) * WIDTH, np.iinfo(np.uint64).max)
    keys[:n] = (hashes & ~PLACE_BITS) | np.arange(n, dtype=np.uint64)
    blocks = keys.reshape(-1, WIDTH)
    onward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - WIDTH + 1
    return (np.minimum(backward[:count], onward[WIDTH - 1 : WIDTH - 1 + count]) & PLACE_BITS).astype(np.int64)


ANCHORS = ("anchor", "piece", "first", "size", "lead", "times")


def anchors(text: bytes) -> np.ndarray:
    """A column of ANCHORS for each run of starts with one anchor.

    `anchor` and `piece` are hashes, of the anchor's bytes and of all that the starts
    cover; `first` is the first start, `size` their number and `lead` the bytes from the
    first start to the anchor. Equal runs in a row, as periodic text has them, are one
    that is there so many `times`, each beginning where the one before ends.
    """
    data = np.frombuffer(text, np.uint8)
    starts = len(text) - LENGTH + 1
    out: list[np.ndarray] = [np.zeros((len(ANCHORS), 0), np.int64)]

    def close(places: np.ndarray, names: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> None:
        if not len(places):
            return
        pieces = np.fromiter(
            (xxhash.xxh3_64_intdigest(text[f:e]) for f, e in zip(firsts.tolist(), (ends + (LENGTH - 1)).tolist())),
            np.uint64,
            len(firsts),
        )
        runs = np.stack([names.view(np.int64), pieces.view(np.int64), firsts, ends - firsts, places - firsts])
        like = runs[[0, 1, 3, 4]]
        news = np.flatnonzero(np.concatenate([[True], (like[:, 1:] != like[:, :-1]).any(axis=0)]))
        found = np.concatenate([runs[:, news], np.diff(np.append(news, len(firsts)))[None]])
        before = out[-1]
        if before.shape[1] and (before[[0, 1, 3, 4], -1] == found[[0, 1, 3, 4], 0]).all():
            before[5, -1] += found[5, 0]
            found = found[:, 1:]
        if found.shape[1]:
            out.append(found)

    left = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for begin in range(0, starts, CHUNK):
        count = min(CHUNK, starts - begin)
        hashes = anchor_hashes(data[begin : begin + count + LENGTH - 1])
        at = least_places(hashes)
        changes = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        places, firsts = at[changes] + np.int64(begin), changes + np.int64(begin)
        if len(left[0]) and left[0][0] == places[0]:
            # The last run of the chunk before goes on.
            places, names, firsts = places[1:], hashes[at[changes[1:]]], firsts[1:]
        else:
            names = hashes[at[changes]]
        places, names, firsts = (np.concatenate(x) for x in zip(left, (places, names, firsts)))
        close(places[:-1], names[:-1], firsts[:-1], firsts[1:])
        left = places[-1:], names[-1:], firsts[-1:]
    if starts > 0:
        close(*left, np.array([starts], np.int64))
    return np.concatenate(out, axis=1)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 2 + [pa.int32()] * 4
    for batch in batches:
        found = [anchors(text.as_py()) for text in batch.column(5).cast(pa.binary())]
        ends = np.cumsum([0, *(f.shape[1] for f in found)])
        rows = np.concatenate(found, axis=1) if found else np.zeros((len(ANCHORS), 0), np.int64)
        fields = pa.StructArray.from_arrays([pa.array(r).cast(k) for r, k in zip(rows, kinds)], ANCHORS)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), fields)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], lists], [*ROW, "n_bytes", "kept_sha256", "anchors"])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of pieces, each with the others' columns: rows of (text, pieces) to rows of PIECE."""
    for batch in batches:
        out = []
        for text, pieces in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
            body = text.as_py()
            for p in pieces.as_py():
                stop = p["first"] + p["size"] + LENGTH - 1
                out.append((p["anchor"], p["piece"], p["n"], p["at"], p["peers"], p["lead"], body[p["first"] : stop]))
        columns = list(zip(*out)) if out else [()] * len(PIECE)
        place = batch.schema.field(1).type.value_type.field("at").type
        kinds = [pa.int64(), pa.int64(), pa.int64(), place, pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], PIECE)


def laid(bodies: list[bytes], leads: np.ndarray) -> np.ndarray:
    """Pieces below each other, with their anchors from column ANCHOR on, zeros around them."""
    width = ANCHOR + LENGTH
    lines = ((b"\0" * (ANCHOR - lead) + body).ljust(width, b"\0") for body, lead in zip(bodies, leads.tolist()))
    return np.frombuffer(b"".join(lines), np.uint8).reshape(-1, width)


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair."""
    out = values[low]
    wide = np.flatnonzero(high > low + 1)
    if len(wide):
        ends = np.stack([low[wide], high[wide]], axis=1).ravel()
        out[wide] = np.minimum.reduceat(np.append(values, 0), ends)[::2]
    return out


def nearest_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix in order with the nearest one before it of smaller position; 0 if there is none.

    `common` is what each shares with its neighbour before; 0 ends the search. Whoever
    finds a larger position goes on from where that one has come to.
    """
    to, length = np.arange(-1, len(position) - 1), common.copy()
    while True:
        larger = np.flatnonzero((length > 0) & (position[to] > position))
        if not len(larger):
            return length
        over = to[larger]
        length[larger], to[larger] = np.minimum(length[larger], length[over]), to[over]


def factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix in order, as far as `common` goes."""
    behind = np.concatenate([[0], common[:0:-1]])
    return np.maximum(nearest_smaller(position, common), nearest_smaller(position[::-1], behind)[::-1])


def repeated_starts(
    matrix: np.ndarray, anchor: np.ndarray, first: np.ndarray, size: np.ndarray, earlier_only: bool
) -> np.ndarray:
    """Which columns of each piece begin a suffix with a factor of LENGTH bytes.

    Pieces are in order of anchor and position. The starts of a piece are the `size`
    columns from `first` on; other columns only help to find the order.
    """
    position = np.arange(len(matrix))
    marked = np.zeros((len(matrix), ANCHOR + 1), bool)
    tails = np.ascontiguousarray(matrix[:, ANCHOR:])
    order = np.argsort(tails.view(f"S{tails.shape[1]}").ravel(), kind="stable")
    order = order[np.argsort(anchor[order], kind="stable")]
    differ = tails[order[1:]] != tails[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), tails.shape[1])
    common = np.concatenate([[0], np.where(anchor[order[1:]] == anchor[order[:-1]], common, 0)])
    for column in range(ANCHOR, -1, -1):
        if column < ANCHOR:
            byte = (anchor * 256 + matrix[:, column])[order]
            moved = np.argsort(byte, kind="stable")
            same = np.flatnonzero(byte[moved[1:]] == byte[moved[:-1]]) + 1
            shared = np.zeros_like(common)
            shared[same] = 1 + _least_between(common, moved[same - 1] + 1, moved[same] + 1)
            order, common = order[moved], shared
        rows = np.flatnonzero(((first <= column) & (column < first + size))[order])
        if len(rows) < 2:
            continue
        between = np.minimum.reduceat(common[: rows[-1] + 1], rows[:-1] + 1)
        # Shorter factors are as good as none.
        reach = np.concatenate([[0], np.where(between >= LENGTH, between, 0)])
        some = np.flatnonzero((reach > 0) | np.append(reach[1:] > 0, False))
        at, reach = order[rows[some]], reach[some]
        long = factors(position[at], reach)
        if not earlier_only:
            long = np.maximum(long, factors(-position[at], reach))
        marked[at, column] = long >= LENGTH
    return marked


FOUND = "anchor long, piece long, start int, count int"


def _ordered_pieces(pieces: DataFrame, earlier_only: bool) -> DataFrame:
    """FOUND for pieces whose anchor is brought together."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(1)
            counts = np.asarray(members.value_lengths()).astype(np.int64)
            inner = members.flatten()
            piece, often, lead = (np.asarray(inner.field(c)) for c in ("piece", "n", "lead"))
            bodies = inner.field("body")
            names = np.repeat(np.asarray(batch.column(0)), counts)
            anchor = np.repeat(np.arange(len(counts)), counts)
            ends = np.cumsum(counts)
            begin = 0
            while begin < len(anchor):
                # Whole anchors, until there are enough pieces.
                stop = int(ends[min(np.searchsorted(ends, begin + LAID), len(ends) - 1)])
                own = slice(begin, stop)
                texts, leads = [b.as_py() for b in bodies[begin:stop]], lead[own].astype(np.int64)
                first, size = ANCHOR - leads, np.array([len(t) - LENGTH + 1 for t in texts])
                marked = repeated_starts(laid(texts, leads), anchor[own] - anchor[begin], first, size, earlier_only)
                if not earlier_only:
                    # A piece that occurs more than once has all of its starts elsewhere too.
                    column = np.arange(ANCHOR + 1)
                    starts = (first[:, None] <= column) & (column < (first + size)[:, None])
                    marked |= starts & (often[own] > 1)[:, None]
                edges = np.diff(marked.astype(np.int8), axis=1, prepend=0, append=0)
                (row, column), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[own][row]),
                        pa.array(piece[own][row]),
                        pa.array((column - first[row]).astype(np.int32)),
                        pa.array((end - column).astype(np.int32)),
                    ],
                    ["anchor", "piece", "start", "count"],
                )
                begin = stop

    members = F.sort_array(F.collect_list(F.struct("at", "piece", "n", "lead", "body")))
    members = F.transform(members, lambda m: F.struct(*(m[c].alias(c) for c in ("piece", "n", "lead", "body"))))
    return pieces.groupBy("anchor").agg(members.alias("members")).mapInArrow(find, FOUND)


def _split_pieces(pieces: DataFrame, earlier_only: bool) -> DataFrame:
    """FOUND for pieces of hot anchors: suffixes of the same 400 bytes are one run of the order.

    All of a run but the first in position have a smaller one beside them, all but the
    last a larger one, so that its first position and its size tell the same as arrays.
    """

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, body in enumerate(batch.column("body")):
                text = body.as_py()
                starts = range(len(text) - LENGTH + 1)
                names = b"".join(xxhash.xxh3_128_digest(text[s : s + LENGTH]) for s in starts)
                halves = np.frombuffer(names, np.int64).reshape(-1, 2)
                same = pa.array(np.full(len(starts), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(same) for c in PIECE[:4]),
                        pa.array(np.arange(len(starts), dtype=np.int32)),
                        pa.array(halves[:, 0].copy()),
                        pa.array(halves[:, 1].copy()),
                    ],
                    [*PIECE[:4], "start", "low", "high"],
                )

    at = pieces.schema["at"].dataType.simpleString()
    names = pieces.mapInArrow(
        name, f"anchor long, piece long, n long, at {at}, start int, low long, high long"
    )
    key = ["anchor", "low", "high"]
    place = F.struct("at", "start")
    whole = names.groupBy(*key).agg(F.sum("n").alias("total"), F.min(place).alias("first"))
    met = names.join(whole, key)
    met = met.where(F.col("first") != place) if earlier_only else met.where(F.col("total") > 1)
    return met.select("anchor", "piece", "start", F.lit(1).alias("count"))


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order of their begins, those that overlap or touch made one."""
    upto = np.maximum.accumulate(ends)
    opens = np.flatnonzero(np.concatenate([[True], begins[1:] > upto[:-1]]))
    return begins[opens], np.append(upto[opens[1:] - 1], upto[-1])


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, kept = [], [], []
        for text, ranges in zip(batch.column(3).cast(pa.binary()), batch.column(4)):
            body, upto, parts = text.as_py(), 0, []
            begins, ends = merged(*(np.asarray(ranges.values.field(c)) for c in ("begin", "end")))
            for begin, end in zip(begins.tolist(), ends.tolist()):
                parts.append(body[upto:begin])
                upto = end
            parts.append(body[upto:])
            removed.append(int((ends - begins).sum()))
            spans.append(len(begins))
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            [*ROW, "n_removed", "n_spans", "kept"],
        )


def _same_row(one: str, other: str) -> Column:
    return F.expr(f"{one}.doc_id <=> {other}.doc_id and {one}.key = {other}.key and {one}.key2 = {other}.key2")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.lit(1), text).alias("key2"),
        text.alias("text"),
    )


def repeated_ranges(docs: DataFrame, scanned: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """(row, ranges) of bytes to remove, and (row, text) of all rows that may have some."""
    every = scanned.select(*ROW, F.inline("anchors"))
    kinds = every.groupBy("anchor").agg(
        F.sum("times").alias("n"), (F.min("piece") != F.max("piece")).alias("differ")
    )
    # Written first, so that the join is one of tables, whose partitions Spark can split.
    kinds = stage(kinds.where(F.col("n") > 1).select("anchor", "differ"), "kinds")
    met = stage(every.join(kinds, "anchor"), "anchors")
    place = F.struct("doc_id", "key", "key2", "first")

    copies = met.groupBy("anchor", "piece", "differ").agg(
        F.sum("times").alias("n"), F.min(place).alias("at"), F.first("size").alias("size"), F.first("lead").alias("lead")
    )
    occurring = met
    all_of_it = F.col("size") * F.col("times")
    if keep_first:
        occurring = met.join(copies.select("anchor", "piece", "at"), ["anchor", "piece"])
        # Of the row with the first one, only what follows it.
        passed = F.when(place == F.col("at"), F.col("size")).otherwise(0)
        whole = occurring.select(*ROW, (F.col("first") + passed).alias("first"), (all_of_it - passed).alias("size"))
        whole = whole.where("size > 0")
    else:
        whole = met.where(~F.col("differ")).select(*ROW, "first", all_of_it.alias("size"))

    texts = docs.alias("d").join(met.select(*ROW).distinct().alias("w"), _same_row("d", "w"), "left_semi")
    texts = stage(texts.select("d.*"), "texts")

    wanted = stage(copies.where("differ"), "copies")
    peers = stage(wanted.groupBy("anchor").agg(F.count("*").alias("peers")), "peers")
    wanted = wanted.join(peers, "anchor")
    part = F.struct("anchor", "piece", "n", "at", "peers", F.col("at.first").alias("first"), "size", "lead")
    cuts = wanted.groupBy(F.col("at.key").alias("key"), F.col("at.key2").alias("key2")).agg(
        F.collect_list(part).alias("pieces")
    )
    one_each = texts.groupBy("key", "key2").agg(F.any_value("text").alias("text"))
    at = wanted.schema["at"].dataType.simpleString()
    pieces = one_each.join(cuts, ["key", "key2"]).select("text", "pieces")
    pieces = stage(
        pieces.mapInArrow(_cut, f"anchor long, piece long, n long, at {at}, peers long, lead int, body binary"), "pieces"
    )
    few = F.col("peers") <= BUCKET_PIECES
    found = _ordered_pieces(pieces.where(few), keep_first).unionByName(
        _split_pieces(pieces.where(~few), keep_first)
    )
    marked = occurring.where("differ").join(found, ["anchor", "piece"])
    begin, size = F.col("first") + F.col("start"), F.col("count")
    if keep_first:
        marked = marked.where(place == F.col("at"))
    else:
        # A piece that is there several times in a row has all of its starts marked.
        several = F.col("times") > 1
        begin, size = F.when(several, F.col("first")).otherwise(begin), F.when(several, all_of_it).otherwise(size)
    starts = whole.unionByName(marked.select(*ROW, begin.alias("first"), size.alias("size")))
    span = F.struct(F.col("first").alias("begin"), (F.col("first") + F.col("size") + (LENGTH - 1)).alias("end"))
    ranges = starts.groupBy(*ROW).agg(F.sort_array(F.collect_set(span)).alias("ranges"))
    return ranges, texts


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) for every row of `docs`.

    Texts are UTF-8 bytes. Removed is each byte inside 400 bytes that also start anywhere
    else, in the same text or another; with `keep_first` only inside those that start
    earlier too, in order of id, null first, and position. All is judged on the input.
    `kept` holds the remaining bytes of rows that lose some and is null for the others,
    whose text stays. Null texts are empty; null ids and repeated rows are kept, rows of
    the same id and text being copies of each other that share their result. Other
    columns are not read. An empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    scanned = keyed.select(
        *ROW,
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("kept_sha256"),
        "text",
    ).mapInArrow(
        _scan,
        "doc_id long, key long, key2 long, n_bytes long, kept_sha256 string, "
        "anchors array<struct<anchor:long,piece:long,first:int,size:int,lead:int,times:int>>",
    )
    scanned = stage(scanned, "scanned")
    ranges, texts = repeated_ranges(keyed, scanned, keep_first)
    # Copies within a row of the same id and text would meet each other.
    texts = texts.dropDuplicates(ROW).alias("t")
    cut = texts.join(ranges.alias("r"), _same_row("t", "r")).select(*(f"t.{c}" for c in ROW), "text", "ranges")
    cut = cut.mapInArrow(_remove, "doc_id long, key long, key2 long, n_removed long, n_spans long, kept binary")
    every = scanned.drop("anchors").alias("s").join(cut.alias("c"), _same_row("s", "c"), "left")
    return every.select(
        "s.doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        "kept",
        F.when(F.col("n_removed") > 0, F.sha2("kept", 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
