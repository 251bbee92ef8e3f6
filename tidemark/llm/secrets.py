"""Credentials in texts, told from copied examples by who has them.

Spans are found by patterns, in DataFrame expressions. A value that many owners have, or
several with many different texts, is an example that is passed around; one that a single
owner has, or a few in a few texts, and that looks random, is somebody's own. Copies of a
text are one repository, however many there are. Values are compared by their SHA-256 only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import let, whole_row
from tidemark.plans.staging import stage


class Pattern(NamedTuple):
    kind: str
    regex: str
    group: int
    least: int
    """Characters that the group has at least."""


BASE = (
    Pattern(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 18),
    # The same runs as those of one character or more, without the short ones.
    Pattern("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Long unbroken strings: reported only where their owners show them to be credentials.
CANDIDATE = Pattern("owned", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", 0, 20)
KINDS = (*BASE, CANDIDATE)

#: A value that one owner has is that owner's. Several owners share one if they are so few
#: and it is in so few different texts; else it is an example.
MAX_OWNERS = 2
MAX_REPOSITORIES = 10
#: Bits a character of a value that looks random, and words that examples have.
LEAST_ENTROPY = 3.0
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|1234567890|abcdef"


def _found(text: Column, pattern: Pattern) -> Column:
    """(gap, gap_bytes, match, value) of each match: what is between it and the one before, all of it, its group."""
    gaps = F.transform(
        F.split(text, pattern.regex, -1), lambda g: F.struct(F.length(g).alias("chars"), F.octet_length(g).alias("bytes"))
    )
    matches = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(pattern.group))
    parts = F.transform(
        F.slice(F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value")), 1, F.size(matches)),
        lambda x: F.struct(
            x["gap"]["chars"].alias("gap"), x["gap"]["bytes"].alias("gap_bytes"), x["match"].alias("match"), x["value"].alias("value")
        ),
    )
    none = F.array().cast("array<struct<gap:int,gap_bytes:int,match:string,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern.regex)), parts).otherwise(none)


def _entropy(text: Column) -> Column:
    n = F.length(text)
    kinds = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(kinds, F.lit(0.0), lambda bits, c: bits - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def _spans(scanned: DataFrame) -> DataFrame:
    """(doc_id, content, kind, rank, start, end, byte_start, byte_end, value): matches that are long enough."""
    key = ["doc_id", "content", "kind", "rank"]
    kinds = [
        scanned.where(F.size(p.kind) > 0).select(
            "doc_id",
            "content",
            "owner",
            F.lit(p.kind).alias("kind"),
            F.lit(rank).alias("rank"),
            F.posexplode(p.kind).alias("nth", "part"),
        )
        for rank, p in enumerate(KINDS)
    ]
    parts = kinds[0]
    for other in kinds[1:]:
        parts = parts.unionByName(other)
    # Rows of the same id and text have the same matches; owners are counted apart from them.
    parts = parts.groupBy(*key, "nth").agg(F.min("part").alias("part"))
    size, size_bytes = F.length("part.match"), F.octet_length("part.match")
    before = Window.partitionBy(*key).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("part.gap") + size).over(before)
    byte_end = F.sum(F.col("part.gap_bytes") + size_bytes).over(before)
    least = F.element_at(F.array(*(F.lit(p.least) for p in KINDS)), F.col("rank") + 1)
    return parts.select(
        *key,
        (end - size).alias("start"),
        end.alias("end"),
        (byte_end - size_bytes).alias("byte_start"),
        byte_end.alias("byte_end"),
        F.col("part.value").alias("value"),
        least.alias("least"),
    ).where(F.length("value") >= F.col("least")).drop("least")


def _ownership(scanned: DataFrame) -> DataFrame:
    """(secret, owners, repositories) of each value anywhere in the corpus."""
    values = F.concat(*(F.col(p.kind)["value"] for p in KINDS))
    secrets = scanned.select("owner", "content", F.explode(F.array_distinct(values)).alias("value"))
    secrets = secrets.select(F.sha2("value", 256).alias("secret"), "owner", "content")
    by_owner = secrets.groupBy("secret", "owner").agg(F.count("*").alias("n"))
    by_repo = secrets.groupBy("secret", "content").agg(F.count("*").alias("n"))
    owners = by_owner.groupBy("secret").agg(F.count("*").alias("owners"))
    repositories = by_repo.groupBy("secret").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "secret")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source"
) -> DataFrame:
    """(doc_id, content, spans) for every row of `docs`.

    `spans` are (start, rank, kind, end, live, byte_start, byte_end), sorted by start and
    order of kinds, start and end in code points, the end exclusive. Spans of the base kinds are all there; `live` tells
    whether the value looks like somebody's own credential. The kind `owned` adds strings
    that overlap no base span and are live. The repository of a value is the text, its owner
    the source; a null source is an owner. Null texts are empty; null ids and repeated rows
    are kept, and rows of the same text are one repository. Other columns are not read. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scanned = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("content"),
        F.col(owner_col).cast("string").alias("owner"),
        *(_found(text, p).alias(p.kind) for p in KINDS),
    )
    scanned = stage(scanned, "scanned")
    held = scanned.where(F.greatest(*(F.size(p.kind) for p in KINDS)) > 0)
    spans = _spans(held).withColumn("secret", F.sha2("value", 256))
    few = (F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES)
    own = (F.col("owners") == 1) | few
    random = (_entropy(F.col("value")) >= LEAST_ENTROPY) & ~F.rlike("value", F.lit(PLACEHOLDER))
    judged = spans.join(_ownership(held), "secret").withColumn("live", own & random)
    mixed = F.rlike("value", F.lit("[0-9]")) & F.rlike("value", F.lit("[A-Za-z]"))
    span = F.struct("start", "rank", "kind", "end", "live", "byte_start", "byte_end")
    judged = judged.where((F.col("kind") != CANDIDATE.kind) | (F.col("live") & mixed))
    lists = _free(judged).groupBy("doc_id", "content").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    found = lists.alias("f")
    every = scanned.select("doc_id", "content").alias("d")
    joined = every.join(found, F.expr("d.doc_id <=> f.doc_id and d.content = f.content"), "left")
    none = F.array().cast(found.schema["spans"].dataType)
    return joined.select("d.doc_id", "d.content", F.coalesce("f.spans", none).alias("spans"))


def _free(spans: DataFrame) -> DataFrame:
    """Base spans, and those others that overlap none of them."""
    base = F.col("kind") != CANDIDATE.kind
    text = Window.partitionBy("doc_id", "content")
    so_far = text.orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, as frames that reach to the end would be gone through again for each row.
    to_come = text.orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumns(
        {"upto": F.max(F.when(base, F.col("end"))).over(so_far), "next": F.min(F.when(base, F.col("start"))).over(to_come)}
    )
    apart = F.coalesce(F.col("upto") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return placed.where(base | apart).drop("upto", "next")


def covers(found: DataFrame) -> DataFrame:
    """(doc_id, content, covers): stretches that spans cover, by bytes, those that overlap made one.

    A stretch is live if one of its spans is.
    """
    rows = found.select("doc_id", "content", F.inline("spans"))
    order = Window.partitionBy("doc_id", "content").orderBy("start", "rank")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") >= upto).cast("int"), F.lit(1))
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("nth", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = rows.groupBy("doc_id", "content", "nth").agg(
        F.min("byte_start").alias("begin"), F.max("byte_end").alias("end"), F.max("live").alias("live")
    )
    listed = F.sort_array(F.collect_list(F.struct("begin", "end", "live"))).alias("covers")
    return stretches.groupBy("doc_id", "content").agg(listed)


def redacted(text: Column, covers: Column) -> Column:
    """`text` with each stretch of `covers` replaced, live ones by [credential], others by [example].

    Pieces are cut by bytes, which takes no search for their characters.
    """

    def piece(data: Column, stop: Column, i: Column, stops: Column) -> Column:
        begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(stops, i - 1)["end"])
        mark = F.when(stop["live"].isNull(), "").when(stop["live"], "[credential]").otherwise("[example]")
        kept = F.substring(data, (begin + 1).cast("int"), (stop["begin"] - begin).cast("int"))
        return F.concat(kept.cast("string"), mark)

    def built(data: Column) -> Column:
        size = F.octet_length(data).cast("long")
        end = F.struct(size.alias("begin"), size.alias("end"), F.lit(None).cast("boolean").alias("live"))
        pieces = lambda stops: F.transform(stops, lambda stop, i: piece(data, stop, i, stops))
        return let(F.concat(covers, F.array(end)), lambda stops: F.array_join(pieces(stops), ""))

    return F.when(F.size(covers) > 0, let(text.cast("binary"), built)).otherwise(text)


def redact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    length_col: str | None = None,
) -> DataFrame:
    """The rows of `docs`, with all columns, the text without what spans cover.

    `length_col` is a column that holds the number of characters and follows the text.
    """
    found = find_secrets(docs, id_col, text_col, owner_col)
    found = found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "content"])
    found = stage(covers(found), "covers")
    text = F.col(text_col).cast("string")
    whole = docs.select(
        whole_row(docs),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("content"),
    )
    same = F.expr("d.doc_id <=> s.doc_id and d.content = s.content")
    met = whole.alias("d").join(found.alias("s"), same, "left").select("d.row", "s.covers")
    met = met.withColumn("clean", redacted(F.col("row")[text_col], F.col("covers")))
    changed = {text_col: F.col("clean")}
    if length_col:
        length = F.length("clean").cast(docs.schema[length_col].dataType)
        changed[length_col] = F.when(F.size("covers") > 0, length).otherwise(F.col("row")[length_col])
    return met.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
