"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a queue in shuffled order, up to three times over.
A document's virtual finish time is the number of words of its queue up to and with it,
divided by the weight of the source. All queues are sorted together by finish time and
cut where the words add up to the budget, so that each source has words in proportion
to its weight, or all of its copies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import whole_row, word_count
from tidemark.plans.staging import stage

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows of a source that are summed in one window, about.
ROWS_PER_BUCKET = 1 << 14

SOURCE = ["no_source", "source_text"]


def _ranked(sources: DataFrame) -> DataFrame:
    """Position of each source in code point order, null last, without one task for all."""
    ordered = sources.repartitionByRange(*SOURCE).sortWithinPartitions(*SOURCE)
    parts = stage(ordered.withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = before.select(
        "part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before")
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy(*SOURCE))
    return parts.join(before, "part").withColumn("rank", F.col("before") + within - 1)


def source_targets(sized: DataFrame) -> DataFrame:
    """(no_source, source_text, source_size, weight, target) of each source.

    Weights are WEIGHTS in code point order of the sources, null last, again and again.
    The words of all are shared by weight; a target stops at MAX_EPOCHS times the size of
    its source and the rest is shared anew among those that are below.
    """
    sources = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    weighed = stage(_ranked(sources).select(*SOURCE, "source_size", weight.alias("weight")), "weights")
    most = MAX_EPOCHS * F.col("source_size")
    level, full = 0.0, -1
    while True:
        capped = most <= F.lit(level) * F.col("weight")
        sums = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"),
            F.coalesce(F.sum(F.when(capped, most)), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count_if(capped).alias("full"),
        ).first()
        if not sums["weight"] or sums["full"] == full:
            break
        level, full = (sums["budget"] - sums["used"]) / sums["weight"], sums["full"]
    return weighed.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("weight")))


def _queued(sized: DataFrame, targets: DataFrame, digits: int) -> DataFrame:
    """Adds `upto`, the words of a source's shuffled queue up to and with the row.

    A source is summed in buckets of its shuffled order, so that none is in one task.
    """
    sized = sized.withColumn("bucket", F.substring("shuffle_key", 1, digits))
    sums = sized.groupBy(*SOURCE, "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = F.sum("bucket_size").over(Window.partitionBy(*SOURCE).orderBy("bucket")) - F.col("bucket_size")
    sums = sums.withColumn("earlier", earlier).join(targets, SOURCE)
    in_bucket = Window.partitionBy(*SOURCE, "bucket").orderBy("shuffle_key", "size", "doc_id", "content")
    upto = F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
    return sized.join(sums, [*SOURCE, "bucket"]).withColumn("upto", F.col("earlier") + upto)


def _finish(epoch: int):
    return (F.col("upto") + epoch * F.col("source_size")) / F.col("weight")


def last_finish(queued: DataFrame) -> float:
    """The virtual time at which the budget, the words of all rows, is used up.

    All copies of all rows are sorted by range and written; sums per range find the one
    in which the budget ends, and only that one is summed row by row.
    """
    copies = F.explode(F.array(*(_finish(e) for e in range(MAX_EPOCHS))))
    entries = queued.where("size > 0").select("size", copies.alias("finish"))
    ordered = entries.repartitionByRange("finish").sortWithinPartitions("finish")
    ordered = stage(ordered.withColumn("part", F.spark_partition_id()), "mix")
    parts = ordered.groupBy("part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("upto", F.sum("words").over(Window.orderBy("part")))
    budget = queued.agg(F.sum("size").alias("budget")).first()["budget"] or 0
    crossing = parts.where(F.col("upto") > budget).orderBy("part").select("part", "upto", "words").first()
    if crossing is None:
        return math.inf
    inside = ordered.where(F.col("part") == crossing["part"])
    by_time = inside.groupBy("finish").agg(F.sum("size").alias("words"))
    taken = F.sum("words").over(Window.orderBy("finish")) + (crossing["upto"] - crossing["words"])
    over = by_time.withColumn("taken", taken).where(F.col("taken") > budget).agg(F.min("finish")).first()[0]
    return over


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, content, size, source_size, target, taken, finish) for every row of `docs`.

    `size` is the number of words, `taken` how many the mix takes of the row, in whole
    copies, at most MAX_EPOCHS. Rows are shuffled by the MD5 of their id and that of their
    text, then by size, id and content, so that runs agree and rows of one id, or of none,
    are dealt out like others. `finish` is the virtual finish time of the first
    copy, the order of the mix. Copies whose finish time is that of the copy which would
    exceed the budget, or later, are left out. Null texts have size 0, a null source is
    the last source. Repeated rows are separate rows, next to each other. An empty
    table gives no rows.
    """
    text = F.col(text_col).cast("string")
    sized = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_text"),
            word_count(text).alias("size"),
            F.xxhash64(text).alias("content"),
            F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))).alias("shuffle_key"),
        ),
        "sized",
    )
    digits = max(2, math.ceil(math.log(max(1, sized.count() / ROWS_PER_BUCKET), 16)))
    queued = stage(_queued(sized, source_targets(sized), digits), "queued")
    end = F.lit(last_finish(queued))
    copies = sum((F.when(_finish(e) < end, 1).otherwise(0) for e in range(MAX_EPOCHS)), F.lit(0))
    return queued.select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source_text")).alias("source"),
        "content",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        _finish(0).alias("finish"),
    )


MIXED = ["size", "source_size", "target", "taken"]


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that the mix takes, in its order, with the columns MIXED after their own.

    `taken` / `size` is the number of copies. Columns of `docs` with these names are
    replaced. Rows with the same id, text and source are one row that has the words taken
    of all.
    """
    row = ["doc_id", "no_source", "source", "content"]
    mixed = mix(docs, id_col, text_col, source_col).withColumn("no_source", F.col("source").isNull())
    mixed = mixed.withColumn("source", F.coalesce("source", F.lit("")))
    mixed = mixed.groupBy(*row).agg(
        *(F.max(c).alias(c) for c in MIXED[:3]), F.sum("taken").alias("taken"), F.min("finish").alias("finish"),
        F.count("*").alias("copies"),
    ).where("taken > 0")
    mixed = stage(mixed, "mixed")
    source = F.col(source_col).cast("string")
    whole = docs.select(
        whole_row(docs),
        F.col(id_col).cast("long").alias("doc_id"),
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source"),
        F.xxhash64(F.col(text_col).cast("string")).alias("content"),
    )
    same = F.expr(
        "d.doc_id <=> m.doc_id and d.no_source = m.no_source and d.source = m.source and d.content = m.content"
    )
    met = whole.alias("d").join(mixed.alias("m"), same).select(
        "d.row", "m.finish", "m.copies", "d.doc_id", "d.no_source", "d.source", "d.content", *(f"m.{c}" for c in MIXED)
    )
    single = met.where("copies = 1").select("row", "finish", *MIXED)
    several = met.where("copies > 1").groupBy(*row).agg(
        *(F.any_value(c).alias(c) for c in ("row", "finish", *MIXED))
    )
    taken = single.unionByName(several.select("row", "finish", *MIXED))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in MIXED]
    return taken.orderBy("finish").select(*own, *MIXED)
