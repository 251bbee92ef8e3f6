"""Vectors as short codes: the nearest entry of a codebook for each part of a vector.

Entries are moved to the mean of their parts in a few rounds, each one aggregation over
all vectors. To find the nearest entry, a part is laid into a coarse grid. For the box of
its cell, the least and the greatest distance of each entry tell which ones cannot be
nearest to any point inside: those whose least distance is above the greatest distance of
another. What is left of the codebook is kept for the cell, so that it is found once for
all parts that share one, and only these entries are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: A component becomes a whole number of 1 / SCALE, down.
SCALE = 1024
#: Whole components beyond are an error, as errors of vectors would not fit 64 bits.
LARGEST = 1 << 26
#: Cells are so many times narrower than the spread of the codebook's components.
CELLS_PER_SPREAD = 4
#: Cells that a task remembers of each part position; beyond, it starts anew.
REMEMBERED = 1 << 15
#: Cells bounded at a time, and distances computed at a time.
CELL_CHUNK, PAIR_CHUNK = 1 << 11, 1 << 18

Codebooks = list[np.ndarray]
"""For each part position a matrix of whole numbers, one row for each entry."""


class Nearest:
    """The nearest entry of one codebook, with a memory of cells."""

    def __init__(self, book: np.ndarray):
        self.book = book
        spread = np.abs(book - book.mean(axis=0)).mean() if book.size else 0
        self.width = max(1, int(spread / CELLS_PER_SPREAD))
        self.memory: dict[bytes, np.ndarray] = {}

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that are nearest to some point of its box, and maybe some others."""
        least = np.zeros((len(cells), len(self.book)), np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            places, at = np.unique(cells[:, d], return_inverse=True)
            low = (places * self.width)[:, None]
            high = low + self.width - 1
            entry = self.book[None, :, d]
            gap = np.maximum(np.maximum(low - entry, entry - high), 0)
            far = np.maximum(np.abs(low - entry), np.abs(high - entry))
            least += (gap * gap)[at]
            most += (far * far)[at]
        possible = least <= most.min(axis=1, keepdims=True)
        return [np.flatnonzero(row) for row in possible]

    def _recall(self, cells: np.ndarray) -> list[np.ndarray]:
        keys = [row.tobytes() for row in cells]
        found: dict[bytes, np.ndarray] = {k: self.memory[k] for k in keys if k in self.memory}
        missing = [i for i, k in enumerate(keys) if k not in found]
        for begin in range(0, len(missing), CELL_CHUNK):
            some = missing[begin : begin + CELL_CHUNK]
            found.update(zip((keys[i] for i in some), self.candidates(cells[some])))
        if len(self.memory) + len(missing) > REMEMBERED:
            self.memory.clear()
        for i in missing[:REMEMBERED]:
            self.memory[keys[i]] = found[keys[i]]
        return [found[k] for k in keys]

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of whole numbers; the first of equally near entries."""
        entry, distance = np.zeros((2, len(values)), np.int64)
        if not values.size:
            return entry, distance
        cells, which = np.unique(values // self.width, axis=0, return_inverse=True)
        which = which.ravel()
        lists = self._recall(np.ascontiguousarray(cells))
        sizes = np.array([len(x) for x in lists], np.int64)[which]
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(values):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIR_CHUNK, "right")))
            own = sizes[begin:stop]
            rows = np.repeat(np.arange(begin, stop), own)
            tried = np.concatenate([lists[i] for i in which[begin:stop]])
            apart = values[rows] - self.book[tried]
            squares = np.einsum("ij,ij->i", apart, apart)
            starts = np.cumsum(own) - own
            best = np.minimum.reduceat(squares, starts)
            hits = np.flatnonzero(squares == np.repeat(best, own))
            _, first = np.unique(rows[hits], return_index=True)
            entry[begin:stop], distance[begin:stop] = tried[hits[first]], best
            begin = stop
        return entry, distance


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), dims)


def whole_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, label, whole) for rows whose vector is there, in whole numbers, without null or non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    too_large = F.raise_error(F.lit(f"a component is larger than {LARGEST // SCALE}"))
    down = lambda v: F.when(F.abs(v * SCALE) > LARGEST, too_large.cast("int")).otherwise(F.floor(v * SCALE).cast("int"))
    return vectors.where(x.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.transform(x, down).alias("whole"),
    )


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> Codebooks:
    """Codebooks of the vectors with the smallest ids, null last."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()
    dims = len(first[0]["whole"]) if first else 0
    rows = np.array([r["whole"] for r in first], np.int64).reshape(len(first), dims)
    return [b.copy() for b in np.split(rows, parts, axis=1)]


def _sums(kept: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """(part, entry, n, sums): number of the parts whose nearest entry it is, and their sums by component."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        nearest = [Nearest(b) for b in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            values = _matrix(batch.column(0), dims)
            for p, part in enumerate(np.split(values, len(books), axis=1)):
                entry, _ = nearest[p](part)
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
                np.add.at(sums[p], entry, part)
        rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        columns = zip(*rows) if rows else ((), (), (), ())
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(map(int, c)) if k == pa.int32() else c, k) for c, k in zip(columns, kinds)], ["part", "entry", "n", "sums"]
        )

    partial = kept.select("whole").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    width = dims // len(books)
    totals = F.array(*(F.sum(F.col("sums")[i]) for i in range(width))) if width else F.array().cast("array<long>")
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), totals.alias("sums"))


def moved(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each entry at the mean of its parts, down to whole numbers; those without parts stay.

    There are as many rows of sums as entries at most, whatever the number of vectors.
    """
    after = [b.copy() for b in books]
    for part, entry, n, total in sums.collect():
        after[part][entry] = [s // n for s in total]
    return after


def encode(kept: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """(vec_id, label, code, error) for each vector."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    label = kept.schema["label"].dataType

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = [Nearest(b) for b in shared.value]
        for batch in batches:
            values = _matrix(batch.column(2), dims)
            found = [n(part) for n, part in zip(nearest, np.split(values, len(nearest), axis=1))]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    return kept.mapInArrow(code, f"vec_id long, label {label.simpleString()}, code string, error long")


def codebooks_digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


class Compressed(NamedTuple):
    codes: DataFrame
    codebooks: Codebooks


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Compressed:
    """Codes (vec_id, label, code, error, label_error) of all kept vectors, and the codebooks.

    Vectors that are null or hold null or non-finite components are dropped. Components
    become whole numbers, floor(SCALE * x); vectors are cut into `parts` equal parts. Each
    codebook, of 256 entries at most, starts with the vectors of the smallest ids and is
    moved to the means of its parts `rounds` times. `code` has two hex digits for each
    part, the nearest entry, the first of equally near ones; `error` is the sum of squared
    distances, `label_error` that of all vectors of the label, nulls together.

    The first kept vector sets the number of components; others of another number, or all
    if it cannot be cut evenly, are left out. Fewer vectors than entries make smaller
    codebooks. A null id comes last, equal ids are in order of their components; repeated
    rows are separate vectors. A component beyond 65,536 is an error. Other columns are not
    read. Where nothing is kept there are no codes and the codebooks are empty.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    kept = stage(whole_vectors(vectors, id_col, vector_col, label_col), "vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select(F.size("whole")).first()
    dims = first[0] if first else 0
    kept = kept.where((F.size("whole") == dims) & F.lit(dims % parts == 0))
    books = first_codebooks(kept, parts, entries)
    for _ in range(rounds):
        books = moved(books, _sums(kept, books, dims))
    codes = stage(encode(kept, books, dims), "codes")
    errors = stage(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "errors")
    met = codes.alias("c").join(errors.alias("e"), F.expr("c.label <=> e.label"))
    return Compressed(met.select("vec_id", "c.label", "code", "error", "label_error"), books)
