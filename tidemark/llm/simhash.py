"""Near copies by SimHash: fingerprints, an index on byte positions, components.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of
their eight bytes, so they share at least six positional bytes. A posting of the
index is keyed by six positions and their bytes: fingerprints with at least six
positional bytes in common meet there, and no others do. Postings of one byte
would each hold 1/256 of the corpus and give pairs in the square of its size;
those of six bytes hold at most 65,536 fingerprints, whatever the corpus. Inside a
posting, fingerprints are tied to the points one bit away from them, which finds
all pairs within two bits without going through all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.components import components, with_least
from tidemark.llm.words import whole_row
from tidemark.plans.staging import stage

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
POSITIONS = 8
LEAST_SHARED = POSITIONS - MAX_DISTANCE
#: The two positions that each posting leaves open.
OPEN_POSITIONS = list(combinations(range(POSITIONS), POSITIONS - LEAST_SHARED))
CHUNK = 1 << 15
#: Fingerprints of which one task makes postings.
PRINTS_PER_TASK = 1 << 14


def _chunks(words: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the word shingles, repeats included, some at a time."""
    n = len(words)
    if n <= SHINGLE_WORDS:
        if n:
            yield np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    for start in range(0, n - SHINGLE_WORDS + 1, CHUNK):
        end = min(start + CHUNK, n - SHINGLE_WORDS + 1)
        shifted = [words[start + i : end + i] for i in range(SHINGLE_WORDS)]
        shingles = map(b" ".join, zip(*shifted))
        yield np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, end - start)


def fingerprint(text: bytes | None) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number; 0 without words or text."""
    total, n = np.zeros(64, np.int64), 0
    # Lower case for ASCII letters only, words between ASCII white space.
    for hashes in _chunks((text or b"").lower().split()):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.uint16)
        n += len(hashes)
    packed = np.packbits((2 * total > n).astype(np.uint8), bitorder="little")
    return int(packed.view(np.int64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        prints = [fingerprint(t.as_py()) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "content", "print"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, print) for every row; the print of a null text is 0.

    `content` is another hash of the text, which tells rows of the same id apart.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))
    return narrow.mapInArrow(_fingerprints, "doc_id long, content long, print long")


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def postings(prints: DataFrame) -> DataFrame:
    """(slot, shared, rest): each distinct fingerprint in every posting of six positions.

    `shared` keeps the six bytes in place, `rest` holds the two open ones.
    """
    entries = []
    for slot, (low, high) in enumerate(OPEN_POSITIONS):
        open_bits = (255 << 8 * low) | (255 << 8 * high)
        kept = ~open_bits & (2**64 - 1)
        kept -= 2**64 if kept >= 2**63 else 0
        rest = _byte(F.col("print"), low) + F.shiftleft(_byte(F.col("print"), high), 8)
        entries.append(
            F.struct(
                F.lit(slot).cast("byte").alias("slot"),
                F.col("print").bitwiseAND(F.lit(kept)).alias("shared"),
                rest.cast("int").alias("rest"),
            )
        )
    return prints.select(F.inline(F.array(*entries)))


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected by steps of at most two bits, one less than members at most.

    Two members within two bits have a point in common that is at most one bit away
    from each; members of one point are within two bits of each other.
    """
    if len(members) == 2:
        a, b = members.tolist()
        return [(a, b)] if (a ^ b).bit_count() <= MAX_DISTANCE else []
    flips = np.array([0, *(1 << i for i in range(16))], members.dtype)
    points = (members[:, None] ^ flips).ravel()
    owners = np.repeat(members, len(flips))
    order = np.argsort(points, kind="stable")
    points, owners = points[order], owners[order]
    together = points[1:] == points[:-1]
    pairs = np.unique(np.stack([owners[:-1][together], owners[1:][together]], 1), axis=0)
    parent = {m: m for m in members.tolist()}

    def root(m: int) -> int:
        while parent[m] != m:
            parent[m] = m = parent[parent[m]]
        return m

    links = []
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            links.append((a, b))
    return links


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ones, others = [], []
        slots, shared = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for slot, kept, rests in zip(slots, shared, batch.column(2)):
            low, high = OPEN_POSITIONS[slot]
            members = np.sort(np.asarray(rests.values.to_numpy(zero_copy_only=False), np.int32))
            for a, b in _forest(members):
                for rest, side in ((a, ones), (b, others)):
                    side.append(kept | ((rest & 255) << 8 * low) | ((rest >> 8) << 8 * high))
        to_long = lambda side: np.array([x & (2**64 - 1) for x in side], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(to_long(ones)), pa.array(to_long(others))], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b, shared_bytes, distance): links that connect all fingerprints within two bits.

    `prints` has distinct fingerprints. Every row is a true link; of the links inside
    a posting as many are returned as connect it. What a pair shares is counted over
    the eight positions, kept from six on, and verified by its differing bits.
    """
    # A file of fingerprints is small for what each becomes.
    spread = prints.repartition(max(1, math.ceil(prints.count() / PRINTS_PER_TASK)), "print")
    met = postings(spread).groupBy("slot", "shared").agg(F.collect_set("rest").alias("rests"))
    met = met.where(F.size("rests") > 1).select("slot", "shared", "rests")
    pairs = met.mapInArrow(_links, "a long, b long").distinct()
    a, b = F.col("a"), F.col("b")
    shared = sum((F.when(_byte(a, p) == _byte(b, p), 1).otherwise(0) for p in range(POSITIONS)), F.lit(0))
    return (
        pairs.withColumns({"shared_bytes": shared, "distance": F.bit_count(a.bitwiseXOR(b))})
        .where(F.col("shared_bytes") >= LEAST_SHARED)
        .where(F.col("distance") <= MAX_DISTANCE)
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content, print) of all rows and (print, root) of all fingerprints."""
    prints = stage(fingerprints(docs, id_col, text_col), "prints")
    nodes = stage(prints.select("print").distinct(), "nodes")
    roots = components(links(nodes), "a", "b")
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left")
    return prints, rooted.select("print", F.coalesce("root", "print").alias("root"))


def group_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    `component_id` is the least id among all documents reachable by links of at most
    two differing bits; the row itself counts, null ids do not, so it is null where
    no reachable row has an id. Texts that are null or without words have fingerprint
    0. Equal fingerprints are one node, so copies never meet each other in pairs.
    Repeated rows are kept; other columns are not read. An empty table gives none.
    """
    prints, rooted = _grouped(docs, id_col, text_col)
    rooted = rooted.join(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "print")
    found = with_least(rooted, "root", "first_id", "print").select("print", F.col("low").alias("component_id"))
    return prints.join(found, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, less all but one of each group of near copies.

    The row with the least id stays, null last; of several with that id the one whose
    text has the least hash; of rows with the same id and text any one.
    """
    prints, rooted = _grouped(docs, id_col, text_col)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    least = prints.groupBy("print").agg(F.min(row).alias("row"))
    kept = least.join(rooted, "print").groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    copies = prints.groupBy("doc_id", "content").agg(F.count("*").alias("copies"))
    kept = stage(
        kept.alias("k")
        .join(copies.alias("c"), F.expr("k.doc_id <=> c.doc_id and k.content = c.content"))
        .select("k.doc_id", "k.content", "copies"),
        "kept",
    )
    whole = docs.select(
        whole_row(docs),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("content"),
    )
    met = whole.alias("d").join(kept.alias("k"), F.expr("d.doc_id <=> k.doc_id and d.content = k.content"))
    single = met.where("copies = 1").select("d.row")
    several = met.where("copies > 1").groupBy("d.doc_id", "d.content").agg(F.any_value("d.row").alias("row"))
    return single.unionByName(several.select("row")).select("row.*")
